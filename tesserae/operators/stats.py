"""Counts over files and directories, and what directories are for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scalars


def language_stats(files: DataFrame) -> DataFrame:
    """``status, language, n``: parsed languages count as fully parsed, whatever was found in a file."""
    status = F.when(F.col("listed_only"), "listed_only").otherwise("fully_parsed")
    return files.groupBy(status.alias("status"), "language").agg(F.count("*").alias("n"))


def ancestors(files: DataFrame) -> DataFrame:
    """``dir, path``: a row for each directory above a file."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.where(F.col("path").contains("/")).select(F.explode(dirs).alias("dir"), "path")


def directory_counts(files: DataFrame) -> DataFrame:
    """``dir, files``: all files below each directory."""
    return ancestors(files).groupBy("dir").agg(F.count("*").alias("files"))


def totals(files: DataFrame) -> DataFrame:
    """``files, markdown, directories`` in one row."""
    one = files.agg(F.count("*").alias("files"), F.count_if("markdown").alias("markdown"))
    return one.crossJoin(ancestors(files).agg(F.count_distinct("dir").alias("directories")))


def directory_purposes(files: DataFrame) -> DataFrame:
    """``dir, purpose`` of directories with files, where one can be inferred."""
    named = files.groupBy(scalars.directory(F.col("path")).alias("dir")).agg(F.collect_set(scalars.file_name(F.col("path"))).alias("names"))
    return named.select("dir", scalars.directory_purpose(F.col("dir"), F.col("names")).alias("purpose")).where("purpose is not null")


def file_importance(symbols: DataFrame) -> DataFrame:
    """``path, importance``: the number of functions, and 5 if there are classes."""
    return symbols.groupBy("path").agg((F.count_if(F.col("kind") == "function") + F.when(F.count_if(F.col("kind") == "class") > 0, 5).otherwise(0)).alias("importance"))
