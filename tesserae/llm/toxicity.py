"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, with weighted votes.

Terms are the words (runs of letters, in lower case), each told by its 64-bit hash. An example is the L2-normed TF-IDF
vector of all its terms, with document frequencies over *all* documents; a text is the vector of those of its terms
that the examples have, normed with its other words as if no document had them. Terms that set labelled toxic from
labelled clean texts apart weigh more; none is left out.

The examples are kept in blocks of similar vectors. For a batch of queries, terms of few examples are scored in full
from their postings; what the common terms add is bounded for each block by its largest weight of each. The blocks of
the largest bounds are scored first, which gives the k-th best cosine so far, and then every block whose bound reaches
it, so the k nearest are exact. Their labels vote with a power of their cosine; the votes of examples that a model of
the other half of the examples gives them, made monotone by pooling adjacent violators, turn votes into calibrated
scores; a text with the vector of examples gets their share of toxic ones. The neighbours are the evidence.

The examples are a bounded sample of the labelled rows: at most ``per_class`` of each label and ``most_words`` words,
by a hash of their id, with equal texts once. An id that is labelled both ways counts as toxic. Nulls count as empty
texts; texts without any term of an example, empty ones among them, get the share of toxic examples among those
without a word. Ties in cosine go to the example that comes first in the index. Repeated rows score alike; an empty
table gives an empty table; without any example every score is 0.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.language_id import fold
from tesserae.llm.texts import map_arrow
from tesserae.storage import cut, discard

#: How many times the weight of other terms is that of terms that set toxic texts apart.
LEAN = 6.0
#: The power of a cosine as a vote, and the vote of the prior.
POWER, FLOOR = 8, 0.001
#: Queries that are searched together.
TOGETHER = 64


def words_of(text: Column) -> Column:
    """The hashes of all the text's words, repeats too."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


class Vectors(NamedTuple):
    """Sparse rows: row r holds ``term[start[r]:start[r + 1]]``, ascending, and as many weights."""

    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def some(self, rows: np.ndarray) -> Vectors:
        size = self.start[rows + 1] - self.start[rows]
        at = spread(self.start[rows], size)
        return Vectors(np.concatenate([[0], np.cumsum(size)]), self.term[at], self.weight[at])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from ``start[k]`` to before ``start[k] + size[k]``, for each k in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def counted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of hashes: where each row starts, the distinct hashes, each row's as places among them, and counts."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    known, place = np.unique(values, return_inverse=True)
    both, n = np.unique(row * max(1, len(known)) + place, return_counts=True)
    row, at = np.divmod(both, max(1, len(known)))
    return np.searchsorted(row, np.arange(len(offsets))), known, at, n


class Weights:
    """The examples' terms and what each weighs."""

    def __init__(self, known: np.ndarray, idf: np.ndarray, rarest: float) -> None:
        self.known, self.idf, self.rarest = known, idf, rarest

    def vectors(self, values: np.ndarray, offsets: np.ndarray) -> Vectors:
        """Rows' vectors over the known terms; with the words that no example has each is of length 1."""
        start, words, at, n = counted(values, offsets)
        rows = len(offsets) - 1
        place = np.searchsorted(self.known, words)
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == words[hit]
        place[~hit] = 0
        each = np.where(hit, self.idf[place], self.rarest) if len(self.known) else np.full(len(words), self.rarest)
        weight = (1 + np.log(n)) * each[at]
        row = np.repeat(np.arange(rows), np.diff(start))
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=rows))
        has = hit[at]
        row, term, weight = row[has], place[at][has], weight[has] / norm[row[has]]
        order = np.lexsort((term, row))
        return Vectors(np.searchsorted(row, np.arange(rows + 1)), term[order], weight[order])


class Index:
    """Example vectors in blocks. Of terms that few examples have, the postings; of the ``widest`` others, each
    example's weight and each block's largest. Places are numbers of examples in the index's own order."""

    def __init__(self, vectors: Vectors, n_terms: int, block: int = 64, widest: int = 512) -> None:
        n = len(vectors.start) - 1
        many = np.bincount(vectors.term, minlength=n_terms)
        # similar vectors share a block: their heaviest term that several examples have is the same
        row, common = vectors.row_of(), many[vectors.term] >= 8
        best = np.lexsort((vectors.term, -vectors.weight, ~common, row))
        heavy = np.full(n, -1)
        if len(row):
            first = best[np.searchsorted(row, np.flatnonzero(np.diff(vectors.start)))]
            heavy[row[first]] = vectors.term[first]
        #: which of the given examples stands at each place
        self.order = np.argsort(heavy, kind="stable")
        self.n, self.block, self.n_blocks = n, block, -(-n // block)
        sorted_ = vectors.some(self.order)
        by = np.argsort(sorted_.term, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(many)])
        self.docs, self.w = sorted_.row_of()[by].astype(np.int32), sorted_.weight[by]
        wide = np.argsort(-many, kind="stable")[:widest]
        self.wide = wide[many[wide] >= max(2, n // 32)]
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[self.wide] = np.arange(len(self.wide))
        self.widen()

    def widen(self) -> None:
        dense = np.zeros((self.n_blocks * self.block, len(self.wide)))
        for k, t in enumerate(self.wide):
            dense[self.docs[self.start[t] : self.start[t + 1]], k] = self.w[self.start[t] : self.start[t + 1]]
        self.dense = dense.reshape(self.n_blocks, self.block, len(self.wide))
        self.top = self.dense.max(axis=1)

    def __getstate__(self) -> dict:
        """Without what the postings tell, as copies are sent and written."""
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "top")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.widen()

    def nearest(self, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k places of largest cosine above 0 for each query, ties by place: cosines, and places; -1 where there
        are fewer."""
        rows = len(queries.start) - 1
        cosine, place = np.zeros((rows, k)), np.full((rows, k), -1)
        for at in range(0, rows if self.n else 0, TOGETHER):
            some = np.arange(at, min(rows, at + TOGETHER))
            cosine[some], place[some] = self._together(queries.some(some), k)
        return cosine, place

    def _together(self, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows, size = len(queries.start) - 1, self.block
        row, column = queries.row_of(), self.column[queries.term]
        # the terms that few examples have are scored in full
        few = column < 0
        term = queries.term[few]
        many = self.start[term + 1] - self.start[term]
        at = spread(self.start[term], many)
        cell = np.repeat(row[few] * (self.n_blocks * size), many) + self.docs[at]
        score = np.bincount(cell, weights=self.w[at] * np.repeat(queries.weight[few], many), minlength=rows * self.n_blocks * size)
        score = score.astype(float, copy=False).reshape(rows, self.n_blocks, size)
        # those that many have are bounded by block
        rest = np.zeros((rows, len(self.wide)))
        rest[row[~few], column[~few]] = queries.weight[~few]
        bound = score.max(axis=2) + rest @ self.top.T + 1e-9
        done = np.zeros((rows, self.n_blocks), dtype=bool)

        def finish(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                some = np.flatnonzero(wanted[:, b])
                score[some, b] += rest[some] @ self.dense[b].T
            done[wanted] = True

        first = min(self.n_blocks, 1 + -(-k // size))
        begin = np.zeros_like(done)
        np.put_along_axis(begin, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        finish(begin)
        so_far = np.where(begin[:, :, None], score, 0.0).reshape(rows, -1)
        reached = np.partition(so_far, -k, axis=1)[:, -k] if k <= so_far.shape[1] else np.zeros(rows)
        finish(~done & (bound >= np.maximum(reached, 1e-12)[:, None]))
        score = np.where(done[:, :, None], np.round(score, 12), 0.0).reshape(rows, -1)
        least = np.maximum(np.partition(score, -k, axis=1)[:, -k] if k <= score.shape[1] else np.zeros(rows), 1e-12)
        cosine, place = np.zeros((rows, k)), np.full((rows, k), -1)
        for r in range(rows):
            best = np.flatnonzero(score[r] >= least[r])
            best = best[np.argsort(-score[r, best], kind="stable")][:k]
            cosine[r, : len(best)], place[r, : len(best)] = score[r, best], best
        return cosine, place


def leaning(vectors: tuple[np.ndarray, np.ndarray], labels: np.ndarray, n_terms: int, least_docs: int = 4, odds: float = 6.0) -> np.ndarray:
    """The terms in at least ``least_docs`` toxic examples whose rate there is ``odds`` times that in the others.
    ``vectors``: starts and terms."""
    start, term = vectors
    label = np.repeat(labels, np.diff(start))
    toxic, clean = np.bincount(term[label == 1], minlength=n_terms), np.bincount(term[label == 0], minlength=n_terms)
    p, q = (toxic + 0.5) / (max(1, (labels == 1).sum()) + 1), (clean + 0.5) / (max(1, (labels == 0).sum()) + 1)
    return np.flatnonzero((toxic >= least_docs) & (p >= odds * q))


def votes(labels: np.ndarray, weights: np.ndarray, cosine: np.ndarray, place: np.ndarray, prior: float) -> np.ndarray:
    """Of each row's neighbours, weighted by a power of the cosine and the class's sampling rate; far neighbours leave
    the vote at the prior."""
    w = np.where(place >= 0, cosine**POWER * weights[place], 0.0)
    return ((w * labels[place]).sum(axis=1) + FLOOR * prior) / (w.sum(axis=1) + FLOOR)


class ToxicityModel:
    """``values, offsets``: the examples' word hashes; ``frequency``: documents with each of their distinct ones, in
    ascending order, of ``n_docs``; ``weights``: rows that an example stands for."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, ids: list, labels: np.ndarray, weights: np.ndarray, frequency: np.ndarray, n_docs: int, k: int) -> None:
        self.k = k
        start, known, term, _ = counted(values, offsets)
        idf, rarest = np.log((1 + n_docs) / (1 + frequency)) + 1, math.log(1 + n_docs) + 1

        def weighing(rows: np.ndarray) -> Weights:
            size = start[rows + 1] - start[rows]
            own = idf.copy()
            own[leaning((np.concatenate([[0], np.cumsum(size)]), term[spread(start[rows], size)]), labels[rows], len(known))] *= LEAN
            return Weights(known, own, rarest)

        def share(rows: np.ndarray) -> float:
            return float((weights * labels)[rows].sum() / weights[rows].sum()) if len(rows) else 0.0

        full, bare = np.flatnonzero(np.diff(start)), np.flatnonzero(np.diff(start) == 0)
        #: of toxic texts among those without a word, and among all
        self.bare, self.prior = share(bare), share(np.arange(len(labels)))
        self.steps = (np.array([0.0]), np.array([self.bare]))
        # what each half's votes for the other are worth
        half = np.arange(len(full)) % 2
        vote = np.zeros(len(full))
        for h in (0, 1):
            of, to = full[half == h], full[half != h]
            if len(of) and len(to):
                w = weighing(of)
                vectors = w.vectors(values, offsets)
                index = Index(vectors.some(of), len(known))
                at = of[index.order]
                vote[half != h] = votes(labels[at], weights[at], *index.nearest(vectors.some(to), k), share(of))
        if len(full) > 1:
            order = np.argsort(vote, kind="stable")
            self.steps = monotone(vote[order].tolist(), labels[full][order].tolist(), weights[full][order].tolist())
        self.weighing = weighing(np.arange(len(labels)))
        self.index = Index(self.weighing.vectors(values, offsets).some(full), len(known))
        at = full[self.index.order]
        self.ids, self.labels, self.weights = [ids[i] for i in at], labels[at], weights[at]

    def scores(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's score, and its neighbours' cosines and places (-1: none)."""
        vectors = self.weighing.vectors(values, offsets)
        rows = len(offsets) - 1
        if not len(self.labels):
            return np.full(rows, self.bare), np.zeros((rows, 0)), np.zeros((rows, 0), dtype=int)
        cosine, place = self.index.nearest(vectors, self.k)
        vote = votes(self.labels, self.weights, cosine, place, self.prior)
        score = self.steps[1][np.maximum(0, np.searchsorted(self.steps[0], vote, side="right") - 1)]
        same = (place >= 0) & (cosine > 1 - 1e-9)
        toxic, n = (same & (self.labels[place] == 1)).sum(axis=1), same.sum(axis=1)
        score = np.where(n > 0, (toxic + 0.05) / (n + 0.1), score)
        return np.where(np.diff(vectors.start) > 0, score, self.bare), cosine, place


def monotone(x: list[float], y: list[int], w: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the start of each step of x, and its mean of y, smoothed by one count of each label."""
    steps: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        if steps and steps[-1][0] == a:
            steps[-1][1] += b * c
            steps[-1][2] += c
        else:
            steps.append([a, b * c, c])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, s, n = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.05) / (s[2] + 0.1) for s in steps])


def hashes_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in an Arrow array of lists, and where each list starts."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, most_words: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]:
    """A bounded sample of the labelled rows, equal texts once: word hashes and where each example's start, ids, labels
    and how many rows each stands for."""
    named = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    named = named.withColumn("u", F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 20)) / float(1 << 20))
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = [min(1.0, per_class / counts.get(y, 1)) for y in (0, 1)]
    taken = named.where(F.col("u") < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))
    # about 2 * per_class ids, so this side may be broadcast
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t")).join(F.broadcast(taken), "i").select("i", "u", "y", F.xxhash64("t").alias("h"), words_of(F.col("t")).alias("w"))
    rows = cut(rows.dropDuplicates(["i", "h"]), "toxicity-sample")
    seen, n, left, chosen = set(), [0, 0], most_words, []
    for r in rows.select("i", "u", "y", "h", F.size("w").alias("words")).orderBy("u", "i", "h").collect():
        if r["h"] not in seen and n[r["y"]] < per_class and r["words"] <= left:
            seen.add(r["h"])
            left -= r["words"]
            n[r["y"]] += 1
            chosen.append((r["i"], r["h"]))
    spot = docs.sparkSession.createDataFrame([(h, k) for k, (_, h) in enumerate(chosen)], "h long, k int")
    table = rows.join(F.broadcast(spot), "h").dropDuplicates(["k"]).select("k", "i", "y", "w").orderBy("k").toArrow().combine_chunks()  # at most `most_words` words
    discard(rows)
    values, offsets = hashes_in(table["w"].chunk(0)) if table.num_rows else (np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64))
    said = table["y"].to_numpy().astype(np.int64)
    stands_for = np.array([counts.get(y, 0) / max(1, n[y]) for y in (0, 1)])
    return values, offsets, table["i"].to_pylist(), said, stands_for[said]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, most_words: int = 2_000_000, k: int = 15) -> ToxicityModel:
    """Fit on the labelled rows that ``labels`` has; document frequencies come from every row of ``docs``."""
    values, offsets, ids, said, weights = examples(docs, labels, id_col, text_col, label_col, per_class, most_words)
    known = np.unique(values)
    n_docs, frequency = 0, np.zeros(len(known), dtype=np.int64)
    if len(known):
        terms = docs.sparkSession.createDataFrame(pa.table({"w": known}))  # at most `most_words` numbers
        spoken = docs.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("w")).join(F.broadcast(terms), "w")
        found = spoken.groupBy("w").agg(F.count("*").alias("n")).toArrow()
        frequency[np.searchsorted(known, found["w"].to_numpy())] = found["n"].to_numpy()
        n_docs = docs.count()
    return ToxicityModel(values, offsets, ids, said, weights, frequency, n_docs, k)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] | dict[str, str] = ("doc_id",), evidence: bool = True) -> DataFrame:
    """``keep`` columns with ``score``, ``predicted`` (1 from 0.5 on) and, with ``evidence``, ``neighbours``: the ids,
    labels and cosines of the nearest examples. Map-only; the bounded model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        ids = np.array([str(i) for i in m.ids] or [""], dtype=object)
        labels = m.labels if len(m.labels) else np.zeros(1, dtype=int)

        def work(column: pa.Array) -> list:
            found, cosine, place = m.scores(*hashes_in(column))
            out = [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            if evidence:
                has = place >= 0
                said = pa.StructArray.from_arrays([pa.array(ids[place[has]], pa.string()), pa.array(labels[place[has]].astype(np.int32)), pa.array(cosine[has])], ["example", "label", "cosine"])
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)), said))
            return out

        return work

    made = "score double, predicted int" + ", neighbours array<struct<example: string, label: int, cosine: double>>" * evidence
    return map_arrow(docs, {c: c for c in keep} if not isinstance(keep, dict) else keep, words_of(F.col(text_col)), made, start)


__all__ = ["ToxicityModel", "examples", "fit", "fold", "score"]
