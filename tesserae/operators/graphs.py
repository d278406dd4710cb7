"""Derived graphs: imports, callers, cross-file calls, and symbols that nothing calls.

Inputs are tables ``files(path)``, ``symbols(path, kind, owner, name, calls, ...)`` and ``imports(path, ord, module)``.
Joins are equi-joins on names or paths; Catalyst chooses how. Rows of empty inputs are none."""

from __future__ import annotations

import re

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import fixed, scalars


def full_name() -> Column:
    """``Class.method``, or the plain name."""
    return F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))


def callables(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "method"))


def call_edges(symbols: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of calls and of recorded callers."""
    named = callables(symbols).withColumn("full", full_name())
    calls = named.select(F.col("full").alias("src"), F.explode("calls").alias("dst"))
    callers = named.select(F.explode("called_by").alias("src"), F.col("full").alias("dst"))
    return calls.unionByName(callers).distinct()


def edge_union(*edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` over all inputs."""
    out = edges[0].select("src", "dst")
    for e in edges[1:]:
        out = out.unionByName(e.select("src", "dst"))
    return out.distinct()


def callers_of(edges: DataFrame) -> DataFrame:
    """``symbol, called_by``: each callee's sorted distinct callers."""
    return edges.groupBy(F.col("dst").alias("symbol")).agg(F.sort_array(F.collect_set("src")).alias("called_by"))


def with_callers(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``symbols`` with ``called_by``: of functions by name, of methods by their bare or their full name. The two ways
    are two equi-joins of narrow rows, not one join with an OR."""
    named = callables(symbols).select("path", "kind", "owner", "name", full_name().alias("full"))
    keys = named.select("path", "kind", "owner", "name", F.explode(F.array_distinct(F.array("name", "full"))).alias("dst"))
    found = keys.join(edges.select("src", "dst"), "dst").groupBy("path", "kind", "owner", "name").agg(F.sort_array(F.collect_set("src")).alias("called_by"))
    found = found.select(F.col("path").alias("_p"), F.col("kind").alias("_k"), F.col("owner").alias("_o"), F.col("name").alias("_n"), "called_by")
    same = F.col("path").eqNullSafe(F.col("_p")) & F.col("kind").eqNullSafe(F.col("_k")) & F.col("owner").eqNullSafe(F.col("_o")) & F.col("name").eqNullSafe(F.col("_n"))
    rest = [c for c in symbols.columns if c != "called_by"]
    return symbols.select(*rest).join(found, same, "left").select(*rest, F.coalesce("called_by", F.array().cast("array<string>")).alias("called_by"))


def module_map(files: DataFrame) -> DataFrame:
    """``module, path`` of Python files; a package's name leads to its ``__init__``."""
    return files.select("path", F.explode(scalars.modules_of(F.col("path"))).alias("module")).where("module != ''").select("module", "path")


def import_targets(imports: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """``path, target``: imported files among ``files``, other than the file itself."""
    known = modules.select("module", F.col("path").alias("target")).join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return imports.select("path", "module").join(known, "module").where("path != target").select("path", "target").distinct()


def xfile_edges(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """``src, dst, rel``: calls whose name an imported file defines."""
    named = callables(symbols)
    calls = named.select("path", F.concat_ws(":", "path", full_name()).alias("src"), F.explode("calls").alias("name"))
    defined = named.select(F.col("path").alias("target"), "name").distinct()
    met = calls.join(targets, "path").join(defined, ["target", "name"])
    return met.select("src", F.concat_ws(":", "target", "name").alias("dst"), F.lit("call").alias("rel"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``src, ord, dst``: other modules as they are; of relative ones the first suffix that makes a file, or nothing."""
    plain = imports.where(~F.col("module").startswith(".")).select(F.col("path").alias("src"), "ord", F.col("module").alias("dst"))
    base = scalars.relative_base(F.col("module"), F.col("path"))
    tried = imports.where(F.col("module").startswith(".")).select(F.col("path").alias("src"), "ord", F.posexplode(F.array(*[F.concat(base, F.lit(s)) for s in fixed.IMPORT_SUFFIXES])).alias("k", "dst"))
    hit = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").groupBy("src", "ord").agg(F.min_by("dst", "k").alias("dst"))
    return plain.unionByName(hit)


def dead_symbols(symbols: DataFrame, *edges: DataFrame) -> DataFrame:
    """``symbol``: path and name of functions whose bare name no edge leads to."""
    called = edge_union(*edges).select(F.col("dst").alias("name")).distinct()
    return symbols.where("kind = 'function'").join(called, "name", "left_anti").select(F.concat_ws(":", "path", "name").alias("symbol"))


def pattern_found(spark: SparkSession, name: Column, pattern: str) -> Column:
    """Whether a Python pattern is found in a name, whatever its case. Patterns that Java's engine takes, with named
    groups written its way, stay in the JVM; others are tried by Python's own, in Arrow batches."""
    java = "(?iu)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JError, PySparkException):

        @F.pandas_udf("boolean")
        def found(names: pd.Series) -> pd.Series:
            own = re.compile(pattern, re.IGNORECASE)
            return names.map(lambda x: x is not None and own.search(x) is not None)

        return found(name)
    return name.rlike(java)


def search(symbols: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """``file, name, type, line``: the first matches by file, functions before classes; none for a wrong pattern."""
    kinds = symbols.where(F.col("kind").isin("function", "class"))
    try:
        re.compile(pattern)
    except re.error:
        kinds, pattern = kinds.limit(0), ""
    order = [F.col("file_ord"), F.when(F.col("kind") == "function", 0).otherwise(1), F.col("ord"), F.col("name")]
    hit = kinds.where(pattern_found(symbols.sparkSession, F.col("name"), pattern)).orderBy(*order).limit(limit)
    return hit.select(F.col("path").alias("file"), "name", F.col("kind").alias("type"), F.coalesce(F.col("line"), F.lit(0)).cast("string").alias("line"))


def file_summaries(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``path, language, functions, classes, imports, purpose, parsed`` of every file. Each side is reduced to one row
    for each file before it is joined."""
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "name")))), lambda x: x["name"])
    named = symbols.groupBy("path").agg(of("function").alias("functions"), of("class").alias("classes"))
    brought = imports.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "module"))), lambda x: x["module"]).alias("imports"))
    none = F.array().cast("array<string>")
    both = files.join(named, "path", "left").join(brought, "path", "left")
    return both.select("path", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("functions", none).alias("functions"), F.coalesce("classes", none).alias("classes"), F.coalesce("imports", none).alias("imports"), F.coalesce("purpose", F.lit("")).alias("purpose"), F.coalesce("parsed", F.lit(False)).alias("parsed"))
