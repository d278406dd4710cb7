"""Incremental maintenance: what changed since a snapshot, its replacement, and staleness."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["root", "path"]


SNAPSHOT = "root string, path string, mtime double, size long, content_hash string, lang string, parse_result string, tool_version string, indexed_at double"


def open_snapshot(spark: SparkSession, path: str, tool_version: str) -> DataFrame:
    """The rows of this version; none where there is no snapshot or it can't be read. Its first rows are read here, so
    a broken file is found now and not in the middle of a build."""
    try:
        found = spark.read.schema(SNAPSHOT).parquet(path)
        found.limit(1).collect()
    except (AnalysisException, Py4JJavaError, PySparkException):
        return spark.createDataFrame([], SNAPSHOT)
    return found.where(F.col("tool_version") == tool_version)


def dirty_files(current: DataFrame, cached: DataFrame, tool_version: str) -> DataFrame:
    """``root, path, dirty, refresh`` of the current files. Two tiers: where time and size agree with the snapshot a
    file is clean and its hash isn't looked at; else it is clean, to be refreshed, if the hashes agree.

    ``current``: root, path, mtime, size, content_hash (computed lazily: Catalyst reads it for the second tier only
    where a scan can skip it); ``cached`` likewise with tool_version. Rows of other versions count as absent."""
    old = cached.where(F.col("tool_version") == tool_version).select(*KEY, F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("content_hash").alias("_hash"))
    both = current.join(old, KEY, "left")
    same = F.coalesce((F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size")), F.lit(False))
    equal = F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False))
    return both.select(*KEY, (~same & ~equal).alias("dirty"), (~same & equal).alias("refresh"))


def dirty_fraction(status: DataFrame, limit: float = 0.5) -> DataFrame:
    """``files, dirty, rebuild`` in one row: a rebuild when more than ``limit`` is dirty."""
    one = status.agg(F.count("*").alias("files"), F.count_if("dirty").alias("dirty"))
    return one.select("files", "dirty", (F.col("dirty") > limit * F.col("files")).alias("rebuild"))


def removed_files(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the snapshot whose file is gone."""
    return cached.join(current.select(*KEY).distinct(), KEY, "left_anti")


def upsert(cached: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot with ``new`` rows in place of those of equal key."""
    return cached.join(new.select(*KEY).distinct(), KEY, "left_anti").unionByName(new)


def purge(cached: DataFrame, current: DataFrame) -> DataFrame:
    return cached.join(current.select(*KEY).distinct(), KEY, "left_semi")


def files_hash(files: DataFrame) -> DataFrame:
    """``files_hash``: 16 hex digits of the SHA-256 over all ``path:mtime`` in order of path.

    By definition one hash over one ordered text, so it is one row's work, of some 60 bytes a file of a project; it
    is for listings of source trees, not for data tables."""
    said = F.sort_array(F.collect_list(F.struct("path", F.concat_ws(":", "path", F.col("mtime").cast("string")).alias("s"))))
    return files.where("path is not null and mtime is not null").agg(F.substring(F.sha2(F.array_join(F.transform(said, lambda x: x["s"]), ""), 256), 1, 16).alias("files_hash"))


def is_stale(recorded: str | None, current: str, requested_k: int | None = None, last_k: int | None = None) -> bool:
    """Whether an index must be made anew: none yet, other files, or a target size more than 2 from the last."""
    if recorded is None:
        return True
    if current != "unknown" and recorded != current:
        return True
    return requested_k is not None and last_k is not None and abs(requested_k - last_k) > 2


def is_stale_at_stop(recorded: str | None, current: str) -> bool:
    """As at the end of a session: an unknown hash counts as stale."""
    return current == "unknown" or recorded != current


def changed(worktree: DataFrame, staged: DataFrame) -> DataFrame:
    """Distinct ``path`` of both."""
    return worktree.select("path").unionByName(staged.select("path")).distinct()
