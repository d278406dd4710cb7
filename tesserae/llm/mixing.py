"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, its expected number of copies. Of all rates between 0 and ``ceiling`` under which every
source's expected words equal its target, those nearest to one copy of each document in relative entropy are
``min(ceiling, exp(tilt * size / mean size))`` with one tilt for each source: the dual's optimum. The dual is convex,
one-dimensional for each source, and solved for all sources at once by Newton steps, each one distributed aggregation
over the table of (source, size, number of documents), with bisection where a step leaves the bracket.

Rates are rounded into whole copies by systematic sampling over the documents in descending size: a document takes
as many copies as its stretch of the running sum of rates holds points of a grid. What rounding leaves is made good
by giving or taking a copy of documents no larger than the rest, again by running sums. Running sums are two-level
(by bucket, then within a bucket), sums are over whole numbers, and order is by hashes of ids: reruns agree at any
partitioning, and no source meets in one task.

Sources are compared by code point, with null last; null texts, and texts without words, have size 0 and take 0
words. Documents of one source that are equal in id and text are exchangeable. Empty tables give empty tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.storage import cut

#: Fixed-point units of a rate and of a sum of rates or words.
UNIT = 1 << 20


def word_count(text: Column) -> Column:
    """Number of matches of [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, ceiling: float) -> dict[str | None, float]:
    """Each source's target: ``share`` of all sizes by weight, at most ``ceiling`` times the source's size; what is
    above that is dealt again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_ = share * sum(size.values()), list(weight)
    out: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > ceiling * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = ceiling * size[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def tilts(histogram: DataFrame, wanted: DataFrame, ceiling: float, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """``sid, tilt, mean`` for each source. ``histogram``: sid, size, n; ``wanted``: sid, target, total, mean, least.

    Newton on the logarithm of the expected words, which is steep and nearly straight in the tilt, inside a bracket."""
    z = F.col("size") / F.col("mean")
    cap = math.log(ceiling)
    state = wanted.select("sid", "target", "total", "mean", F.when(F.col("target") < F.col("total"), -1e4).otherwise(0.0).alias("lo"), F.when(F.col("target") <= F.col("total"), 0.0).otherwise(cap * F.col("mean") / F.col("least") + 1e-9).alias("hi"), F.lit(0.0).alias("tilt"), F.lit(False).alias("done"))
    state = state.where("total > 0")
    for _ in range(rounds):
        x = F.least(F.col("tilt") * z, F.lit(cap))
        words = F.col("size") * F.col("n") * F.exp(x)
        whole = lambda c: F.sum(F.round(c * 1024).cast("decimal(38,0)")).cast("double") / 1024  # noqa: E731  a sum that doesn't depend on the order
        sums = histogram.join(F.broadcast(state.select("sid", "tilt", "mean")), "sid").groupBy("sid").agg(whole(words).alias("f"), whole(F.when(F.col("tilt") * z < cap, words * z).otherwise(0.0)).alias("g"))
        step = F.col("tilt") - F.try_divide(F.log(F.try_divide("f", "target")) * F.col("f"), F.col("g"))
        lo = F.when(F.col("f") < F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(F.col("f") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        near = F.abs(F.col("f") - F.col("target")) <= tolerance * F.col("target") + 0.01
        state = state.join(sums, "sid").select("sid", "target", "total", "mean", lo.alias("lo"), hi.alias("hi"), "tilt", near.alias("done"), step.alias("step"))
        state = state.select("sid", "target", "total", "mean", "lo", "hi", F.when(F.col("done"), F.col("tilt")).when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"), "done")
        state = cut(state, "mixing-newton")
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select("sid", "tilt", "mean")


def running(rows: DataFrame, value: str, out: str, bucket: list[str], order: list[str]) -> DataFrame:
    """The sum of ``value`` over the rows of a source before each row, as ``out``; ``bucket`` columns come first in
    the order. Bucket sums are added up over a small table, rows within their bucket."""
    sums = rows.groupBy("sid", *bucket).agg(F.sum(value).alias("_b"))
    before = Window.partitionBy("sid").orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    start = sums.withColumn("_s", F.coalesce(F.sum("_b").over(before), F.lit(0))).drop("_b")
    inside = Window.partitionBy("sid", *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(start, ["sid", *bucket]).withColumn(out, F.col("_s") + F.col("_i")).drop("_s", "_i")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: int = 2, spread: int = 32, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, source_col, size, source_size, target, copies, taken`` for each row.

    ``spread`` is the number of hash buckets for each size class in the running sums, so a source that holds a third of
    all rows is summed by some hundred tasks."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit("mix"), F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    rows = cut(rows.withColumn("sid", F.concat(F.when(F.col("s").isNull(), "1").otherwise("0"), F.coalesce("s", F.lit("")))), "mixing")  # null sorts last and joins
    histogram = cut(rows.groupBy("sid", "size").agg(F.count("*").alias("n")), "mixing-sizes")
    per = histogram.groupBy("sid").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    known = per.collect()  # one row for each source
    goal = targets([(None if r["sid"][0] == "1" else r["sid"][1:], r["total"]) for r in known], weights, share, ceiling)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["sid"], float(goal[None if r["sid"][0] == "1" else r["sid"][1:]]), r["total"], r["total"] / max(1, r["n"]), float(r["least"] or 1)) for r in known], "sid string, target double, total long, mean double, least double")
    tilted = tilts(histogram, wanted, ceiling)
    rate = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(ceiling)))
    # a source at its ceiling takes every document that often
    rate = F.when(F.col("target") >= ceiling * F.col("total"), float(ceiling)).otherwise(F.coalesce(rate, F.lit(0.0)))
    each = rows.join(F.broadcast(wanted.select("sid", "target", "total")), "sid").join(F.broadcast(tilted.select("sid", "tilt", F.col("mean"))), "sid", "left")
    each = each.select("i", "s", "sid", "size", "h", "target", "total", F.round(rate * UNIT).cast("long").alias("rate"))
    each = each.withColumn("c", -F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int")).withColumn("b", F.pmod("h", F.lit(spread)).cast("int"))
    each = running(each, "rate", "sum", ["c", "b"], ["size", "h", "i"])
    grid = lambda x: F.floor((x + UNIT // 2) / UNIT).cast("long")
    each = cut(each.withColumn("copies", grid(F.col("sum") + F.col("rate")) - grid(F.col("sum"))).drop("sum"), "mixing-copies")
    for k in range(3):
        each = cut(level(each, ceiling, spread), f"mixing-level{k}")
    return each.select(F.col("i").alias(id_col), F.col("s").alias(source_col), "size", F.col("total").alias("source_size"), "target", F.col("copies").cast("long"), (F.col("copies") * F.col("size")).alias("taken"))


def level(each: DataFrame, ceiling: int, spread: int) -> DataFrame:
    """One more copy, or one less, of documents, large ones first, while what their source lacks, or has too much,
    covers them. Less than the next document's size stays, and the next call takes smaller ones for that."""
    gap = each.groupBy("sid").agg(F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("gap"))
    rows = each.join(F.broadcast(gap), "sid")
    free = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < ceiling).otherwise(F.col("copies") > 0)
    rows = rows.withColumn("w", F.when(free, F.col("size")).otherwise(F.lit(0))).withColumn("b", F.pmod("h", F.lit(spread)).cast("int"))
    rows = running(rows, "w", "sum", ["c", "b"], ["size", "h", "i"])
    change = F.when((F.col("w") > 0) & (F.col("sum") + F.col("w") <= F.abs("gap")), F.signum(F.col("gap")).cast("long")).otherwise(F.lit(0))
    return rows.withColumn("copies", F.col("copies") + change).drop("gap", "w", "sum")
