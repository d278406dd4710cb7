"""Keeping an index within a size: lossy steps, each only if the ones before don't suffice."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_files(files: DataFrame, target: int, buckets: int = 64) -> DataFrame:
    """The most important files that a target of all their sizes allows: at least ten, else nine tenths of
    ``target / size`` of them. ``files``: path, importance, ord, size. Ranks come from counts by importance, so only
    the rows of the one importance at the edge are ranked among themselves."""
    told = files.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    n, s = told["n"], told["s"] or 0
    if s <= target:
        return files
    keep = max(10, int(n * (target / s) * 0.9))
    counts = files.groupBy("importance").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("importance")).rowsBetween(Window.unboundedPreceding, -1)
    edge = counts.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))  # one row for each importance
    both = files.join(edge.select("importance", "before", F.col("n").alias("_n")), "importance").where(F.col("before") < keep)
    whole = both.where(F.col("before") + F.col("_n") <= keep)
    partly = both.where(F.col("before") + F.col("_n") > keep)
    rest = keep - (partly.agg(F.first("before").alias("b")).first()["b"] or 0)
    return whole.select(*files.columns).unionByName(partly.orderBy("ord").limit(max(0, rest)).select(*files.columns))


def size_of(index: dict) -> int:
    return len(json.dumps(index, separators=(",", ":")))


def shorten_docs(files: dict, most: int | None) -> None:
    """Cut, or with None blank, the fifth field of each function's text."""
    for entry in files.values():
        if len(entry) > 1 and isinstance(entry[1], list):
            for k, text in enumerate(entry[1]):
                parts = text.split(":")
                if len(parts) >= 5 and (most is None or len(parts[4]) > most):
                    parts[4] = "" if most is None else parts[4][: most - 3] + "..."
                    entry[1][k] = ":".join(parts)


def fit(dense: dict, target: int) -> dict:
    """The dense index within ``target`` characters of JSON if the steps suffice; the input itself if it fits."""
    if size_of(dense) <= target:
        return dense
    out = copy.deepcopy(dense)

    def shorter_tree() -> None:
        if len(out.get("tree", [])) > 10:
            out["tree"] = [*out["tree"][:10], "... (truncated)"]

    def fewer_files() -> None:
        keep = max(10, int(len(out["f"]) * (target / size_of(out)) * 0.9))
        weight = lambda e: (len(e[1]) if len(e) > 1 and isinstance(e[1], list) else 0) + 5 * (len(e) > 2)
        best = sorted(out["f"], key=lambda p: -weight(out["f"][p]))[:keep]
        out["f"] = {p: e for p, e in out["f"].items() if p in set(best)}

    for step in (shorter_tree, lambda: shorten_docs(out.get("f", {}), 40), lambda: shorten_docs(out.get("f", {}), None), lambda: out.pop("d", None), fewer_files):
        step()
        if size_of(out) <= target:
            break
    return out
