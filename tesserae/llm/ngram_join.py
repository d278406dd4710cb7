"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its ``n``-word shingles (a text of fewer words is one shingle; words are what white space
parts). Documents of equal sets are a class. Each of ``trees`` prefix tries holds the classes' labels, ``longest``
MinHash values each; two sets of Jaccard similarity s share the first d values of a label with probability s^d. The
tries are walked from the leaves up. Classes under one node are candidates; only the node's least class goes on to the
next shorter prefix, so what met at a long prefix isn't matched again. After each level the share of links that the
prefixes haven't met is estimated from the number of trees in which each likely link has met; prefixes are shortened
until that is below ``1 - recall``, or down to the length at which even links of just the threshold's similarity meet
with that recall. Candidates are joined to groups by stars (each class with its node's least, never all pairs), and
within a group every pair is verified exactly, in tiles of bounded size, by counting common shingles. Counts of links
and spanning links leave a tile, not its pairs.

Texts without a word are one class of their own and are linked with each other only. Nulls count as empty texts.
Repeated rows are copies like any others. Empty tables give empty tables. A shingle is its 64-bit hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.graph import components
from tesserae.llm.texts import map_texts, release
from tesserae.storage import cut, discard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def depth_for(recall: float, threshold: float, trees: int, longest: int) -> int:
    """The longest prefix at which a pair of the threshold's similarity meets in a tree with at least this recall."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    split = [WORD.findall(t) if t else [] for t in texts]
    flat = [w for s in split for w in s]
    if not flat:
        return [np.zeros(0, dtype=np.uint64) for _ in split]
    h = pd.util.hash_array(np.array(flat, dtype=object), categorize=len(flat) > 5000)
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(n):
        rolled[: len(h) - k] = rolled[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    rolled = mixed(rolled)
    out, at = [], 0
    for s in split:
        if len(s) >= n:
            out.append(np.unique(rolled[at : at + len(s) - n + 1]))
        elif s:
            told = 0
            for x in h[at : at + len(s)].tolist():
                told = (told * 0x9E3779B97F4A7C15 + x + len(s)) & MASK
            out.append(mixed(np.array([told], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += len(s)
    return out


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHash:
    def __init__(self, size: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> bytes:
        low = np.full(len(self.a), np.uint64(MASK))
        for k in range(0, len(s), 512):  # stays within a cache
            np.minimum(low, (s[k : k + 512, None] * self.a + self.b).min(axis=0), out=low)
        return (low >> np.uint64(32)).astype(">u4").tobytes()


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of Jaccard similarity at least ``threshold``, each once. ``left``: the side of each set; if both sides
    are there, only pairs across them. Exact: common shingles are counted."""
    p, q, m = threshold.numerator, threshold.denominator, len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    cross = bool(left.any() and not left.all())
    rows = np.flatnonzero(left) if cross else np.arange(m)
    cols = np.flatnonzero(~left) if cross else rows
    if m <= 6:
        found = [(i, j) for i in rows for j in cols if (cross or i < j) and (q + p) * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= p * (size[i] + size[j])]
        found = [(i, j) for i, j in found if size[i] and size[j]]
        return np.array([i for i, _ in found], dtype=int), np.array([j for _, j in found], dtype=int)
    shingle, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    shared = np.bincount(number, minlength=len(shingle)) > 1  # others are in no intersection
    place = np.cumsum(shared) - 1
    use = shared[number]
    number, owner = place[number[use]], owner[use]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    common = np.zeros((len(rows), len(cols)), dtype=np.float32)
    at = np.full(m, -1)
    at[rows] = np.arange(len(rows))
    to = np.full(m, -1)
    to[cols] = np.arange(len(cols))
    width = max(256, (1 << 23) // m)
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(number, [start, start + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[owner[a:b], number[a:b] - start] = 1
        common += x[rows] @ x[cols].T  # counts below 2^24 are exact
    enough = (q + p) * common.astype(np.int64) >= p * (size[rows][:, None] + size[cols][None, :])
    enough &= (size[rows] > 0)[:, None] & (size[cols] > 0)[None, :]
    i, j = np.nonzero(enough)
    i, j = rows[i], cols[j]
    return (i, j) if cross else (i[i < j], j[i < j])


def roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each node's least fellow under the links."""
    root = np.arange(m)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def unmet(pairs: DataFrame, depth: int, trees: int, threshold: float) -> float:
    """The estimated share of links that meet in no tree at this prefix length. ``pairs``: met, the number of trees in
    which a pair has met; those of at least half as many as links of the threshold's similarity meet in are taken for
    links, and one met in the share q of the trees is missed with probability (1 - q)^trees."""
    likely = pairs.where(F.col("met") >= 0.5 * trees * threshold**depth)
    return likely.agg(F.avg(F.pow(1 - F.least(F.col("met") / trees, F.lit(1.0)), F.lit(trees)))).first()[0] or 0.0


def forest(labels: DataFrame, trees: int, longest: int, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """``a, b`` for candidates, and the shortest prefix that was matched. ``labels``: hub (a class), tree, label."""
    least = depth_for(recall, threshold, trees, longest)
    nodes, stars, old = labels, None, None
    for depth in range(longest, least - 1, -1):
        keyed = nodes.select("hub", "tree", "label", F.xxhash64("tree", F.substring("label", 1, 4 * depth)).alias("node"))
        tops = keyed.groupBy("node").agg(F.min("hub").alias("top"), F.count("*").alias("many"))
        met = keyed.select("hub", "node").join(tops.where("many > 1").select("node", "top"), "node").where("hub != top")
        pairs = cut(met.groupBy(F.col("hub").alias("a"), F.col("top").alias("b")).agg(F.count("*").alias("met")), "forest-stars")
        stars = pairs if stars is None else stars.unionByName(pairs)
        if depth == least or unmet(stars, depth, trees, threshold) <= 1 - recall:
            break
        nodes = cut(keyed.groupBy("node").agg(F.min_by(F.struct("tree", "label"), "hub").alias("x"), F.min("hub").alias("hub")).select("hub", "x.tree", "x.label"), "forest-nodes")
        if old is not None:
            discard(old)
        old = nodes
    return stars.select("a", "b"), depth


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, trees: int = 24, longest: int = 6, block: int = 2048, block_shingles: int = 3_000_000, small: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, class_id, n_links`` for each row: the least id among the documents that links join it with, and the
    number of documents it is linked with (copies count)."""
    ratio = Fraction(threshold).limit_denominator(1000)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def start():
        hashes = MinHash(trees * longest)

        def work(texts: list[str | None]) -> list[list]:
            sets = shingle_sets(texts, n)
            return [[set_key(s) for s in sets], [len(s) for s in sets], [hashes.signature(s) if len(s) else b"" for s in sets]]

        return work

    signed = cut(map_texts(docs, {id_col: "i"}, text_col, "key binary, size long, sig binary", start, rows=500), "forest")
    # one label for each class and tree; a class is named by a number that no other has
    classes = signed.groupBy("key").agg(F.min("i").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "forest-classes")
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    labels = classes.where("size > 0").select(F.col("cid").alias("hub"), "sig", tree.alias("tree"))
    labels = labels.select("hub", "tree", F.substring(F.col("sig"), F.col("tree") * (4 * longest) + 1, F.lit(4 * longest)).alias("label"))
    stars, _ = forest(labels, trees, longest, threshold, recall)
    group = cut(components(stars), "forest-groups")

    members = classes.join(group, F.col("cid") == F.col("node")).select("first", "key", "cid", "copies", "size", "root")
    extent = group.join(classes.select("cid", "size"), F.col("cid") == F.col("node")).groupBy("root").agg(F.count("*").alias("many"), F.sum("size").alias("shingles"))
    extent = extent.select("root", F.greatest(F.ceil(F.col("many") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks"))
    members = cut(members.join(extent, "root"), "forest-members")
    wanted = members.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    bins = max(1, (wanted["s"] or 0) // 500_000)
    # a group of one block shares a tile with other such groups; a larger one has a tile for each pair of its blocks
    own = F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int")
    tiles = F.when(F.col("blocks") == 1, F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("tile"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("left")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.xxhash64("root", F.least(own, o), F.greatest(own, o)).alias("tile"), F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), (own <= o).alias("left")))
    )

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.iloc[k : k + 200].copy()
                sets = shingle_sets(part["t"].tolist(), n)
                part["set"] = [s.tobytes() for s in sets]
                part = part[[set_key(s) == key for s, key in zip(sets, part["key"], strict=True)]]  # ids may repeat
                yield part[["cid", "copies", "root", "blocks", "set"]]
        release()

    # texts of other documents needn't be sent anywhere: their ids are filtered out first, if the wanted ones are
    # counted to be few enough to be sent to them
    ids = members.select(F.col("first").alias("i")).distinct()
    near = rows.join(F.broadcast(ids), "i", "left_semi") if (wanted["n"] or 0) <= small else rows
    texts = near.join(members.withColumnRenamed("first", "i"), "i").select("t", "key", "cid", "copies", "root", "blocks")
    sets = texts.mapInPandas(sets_of, "cid long, copies long, root long, blocks int, set binary")
    dealt = sets.select("cid", "copies", "root", "blocks", "set", F.explode(tiles).alias("at")).select("cid", "copies", "root", "blocks", "set", "at.tile", "at.x", "at.y", "at.left")

    def verify(tile: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, x, y), g in tile.drop_duplicates(["root", "x", "y", "cid"]).groupby(["root", "x", "y"], sort=False):
            held = [np.frombuffer(b, dtype=np.uint64) for b in g["set"]]
            i, j = similar_pairs(held, g["left"].to_numpy() if x != y else np.ones(len(g), dtype=bool), ratio)
            copies, cid = g["copies"].to_numpy(), g["cid"].to_numpy()
            links = np.bincount(i, weights=copies[j], minlength=len(g)) + np.bincount(j, weights=copies[i], minlength=len(g))
            out.append(pd.DataFrame({"cid": cid, "links": links.astype("int64"), "to": cid[roots(len(g), i, j)], "large": g["blocks"].to_numpy() > 1}))
        release()
        return pd.concat(out)

    verified = cut(dealt.groupBy("tile").applyInPandas(verify, "cid long, links long, to long, large boolean"), "forest-links")
    # links across tiles join what no single tile sees
    across = verified.where("large")
    within = verified.where("not large").select(F.col("cid").alias("node"), F.col("to").alias("top"))
    if across.limit(1).count():
        joined = components(across.select(F.col("cid").alias("a"), F.col("to").alias("b")))
        within = within.unionByName(joined.select("node", F.col("root").alias("top")))
    counts = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.select("key", "cid", "first", "copies").join(counts, "cid", "left").join(within.withColumnRenamed("node", "cid"), "cid", "left")
    told = cut(told.select("key", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "cid").alias("top")), "forest-told")
    least = told.groupBy("top").agg(F.min("first").alias("class_id"))
    told = told.join(least, "top").select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return signed.select("i", "key").join(told, "key").select(F.col("i").alias(id_col), "class_id", "n_links")
