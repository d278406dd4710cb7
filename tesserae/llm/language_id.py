"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its words' subwords (the word itself and its character n-grams with word
marks, each hashed to a row of one table); a linear softmax over that mean gives the languages' probabilities. The
softmax is linear, so a trained model needs only one row of class scores per bucket, and a word's row is the sum over
its subwords. Probabilities are calibrated by a temperature fitted on a held-back part of the training sample, and
the rejection level is the probability below which that part was right less often than ``reject_precision``.

The sample that the model is fitted on is bounded: at most ``per_language`` rows of each language, taken by a hash of
their id and of at most ``most_chars`` characters together, so every run takes the same ones. Everything else is over
all rows. Nulls, and texts without a letter, get the language ``und`` with score 0 and are rejected; numerals such as
½ or ① are no letters. Ties between languages go to the first by code point. Repeated
rows get equal results, empty tables give an empty table, and without any training row every text is ``und``.
"""

from __future__ import annotations

import copy
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.texts import map_texts
from tesserae.storage import cut, discard

#: A word is a run of letters and of numerals that aren't digits, with a letter in it.
RUN = re.compile(r"[^\W\d_]+")
#: What rejected texts without a letter are called.
UNDETERMINED = "und"


def has_letter(run: str) -> bool:
    return run.isalpha() or any(map(str.isalpha, run))


def words_of(text: str) -> list[str]:
    return [w for w in RUN.findall(text.lower()) if has_letter(w)]


def subwords(word: str, buckets: int, least: int = 1, most: int = 3) -> list[int]:
    """Buckets of the word with its marks and of its character n-grams, be the word a run of any length."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in range(least, most + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams if g not in "<>"]


class LanguageModel:
    """``scores``: float32 [buckets, languages], each row an embedding under the linear layer."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float) -> None:
        self.languages, self.scores, self.bias, self.temperature, self.reject_below = languages, scores, bias, temperature, reject_below
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.letters = 0
        self.rows = np.zeros((1024, len(self.languages) + 1), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "rows", "letters")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def row(self, word: str) -> int:
        """The place of a run's summed class scores and subword count; runs without a letter have none."""
        k = len(self.index)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = subwords(word, len(self.scores)) if has_letter(word) else []
        for j in range(0, len(at), 30_000):  # a long run's rows aren't held at once
            self.rows[k, :-1] += self.scores[at[j : j + 30_000]].sum(axis=0)
        self.rows[k, -1] = len(at)
        self.index[word] = k
        self.letters += len(word)
        return k

    def probabilities(self, text: str) -> np.ndarray | None:
        words = RUN.findall(text.lower())
        if not words:
            return None
        if len(self.index) > 200_000 or self.letters > 20_000_000:  # bounds the worker's memory
            self.clear()
        index, slow = self.index, self.row
        at = [index[w] if w in index else slow(w) for w in words]
        total = self.rows[at].sum(axis=0, dtype=np.float64)
        if not total[-1]:
            return None
        return softmax((total[:-1] / total[-1] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 5, rate: float = 0.5, words: int = 400, reject_precision: float = 0.9, seed: int = 7) -> LanguageModel:
    """Fit on the given texts. Each step of an epoch takes a random window of ``words`` of one text's words, so that
    short texts are learned as well as long ones; whole texts are seen across epochs."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([languages.index(x) for x in labels])
    split = [words_of(t) for t in texts]
    memo: dict[str, np.ndarray] = {}

    def features(some: list[str]) -> np.ndarray:
        for w in some:
            if w not in memo:
                memo[w] = np.array(subwords(w, buckets))
        return np.concatenate([memo[w] for w in some])

    usable = np.array([i for i in range(len(split)) if split[i]], dtype=int)
    back = usable[::10] if len(usable) >= 100 else usable[:0]
    fit = np.setdiff1d(usable, back)
    table = (rng.random((buckets, dim)) - 0.5) / dim
    layer, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    steps, done = epochs * max(1, len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            size = int(rng.choice([5, 20, words]))
            start = int(rng.integers(0, max(1, len(split[i]) - size + 1)))
            at = features(split[i][start : start + size])
            lr, done = rate * (1 - done / steps), done + 1
            mean = table[at].mean(axis=0)
            error = softmax(mean @ layer + bias)
            error[y[i]] -= 1
            push = layer @ error
            layer -= lr * np.outer(mean, error)
            bias -= 0.1 * lr * error
            np.subtract.at(table, at, lr * push / len(at))
    scores = table @ layer
    model = LanguageModel(languages, scores.astype(np.float32), bias, 1.0, 0.0)
    if len(back):
        # short windows of the held-back texts: whole texts are nearly always right and would calibrate nothing
        z, right = [], []
        for i in back:
            for size in (3, 10, 50):
                start = int(rng.integers(0, max(1, len(split[i]) - size + 1)))
                z.append(scores[features(split[i][start : start + size])].mean(axis=0) + bias)
                right.append(y[i])
        z, right = np.array(z), np.array(right)
        grid = np.geomspace(0.05, 5, 60)
        loss = [-np.log(softmax(z / t)[np.arange(len(right)), right] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        top, good = p.max(axis=1), p.argmax(axis=1) == right
        for level in np.linspace(1 / len(languages), 1, 50)[::-1]:
            near = (top >= level - 0.05) & (top <= level + 0.05)
            if near.sum() >= 5 and good[near].mean() < reject_precision:
                model.reject_below = float(level)
                break
    return model


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, most_chars: int) -> tuple[list[str], list[str]]:
    """At most ``per_language`` texts of each language, by a hash of the id, and ``most_chars`` characters of all: a
    bounded number of bytes to the driver. Each language's first text that fits is taken before any second one."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    slim = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), key.alias("k"), F.xxhash64(text_col).alias("h"))
    counts = {r["l"]: r["n"] for r in slim.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    spread = F.pmod(F.col("k"), F.lit(1 << 20)) / float(1 << 20)
    taken = cut(slim.where(spread < F.element_at(share, F.col("l"))).dropDuplicates(["l", "k", "h"]), "language-sample")
    seen, left, chosen = dict.fromkeys(counts, 0), most_chars, []
    rows = sorted(taken.select("l", "k", "h", F.length("t").alias("n")).collect(), key=lambda r: (r["l"], r["k"], r["h"]))
    turns: list[tuple] = []
    for r in rows:
        if seen[r["l"]] < per_language:
            turns.append((seen[r["l"]], r))
            seen[r["l"]] += 1
    for _, r in sorted(turns, key=lambda x: x[0]):
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["l"], r["k"], r["h"]))
    spot = labelled.sparkSession.createDataFrame(chosen, "l string, k long, h long")
    kept = taken.join(F.broadcast(spot), ["l", "k", "h"]).collect()  # at most `most_chars` characters
    discard(taken)
    kept.sort(key=lambda r: (r["l"], r["k"], r["t"]))
    return [r["t"] for r in kept], [r["l"] for r in kept]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, most_chars: int = 50_000_000, **how) -> LanguageModel:
    return train(*sample(labelled, id_col, text_col, lang_col, per_language, most_chars), **how)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``rejected`` (the score is below the calibrated level).
    Map-only; the model (4 bytes a bucket and language) goes to each worker once, as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = copy.copy(shared.value)  # what it remembers of words ends with the task
        m.clear()

        def work(texts: list[str | None]) -> list[list]:
            said, score = [], []
            for text in texts:
                p = m.probabilities(text) if text and m.languages else None
                k = -1 if p is None else int(p.argmax())
                said.append(UNDETERMINED if k < 0 else m.languages[k])
                score.append(0.0 if k < 0 else float(p[k]))
            return [said, score, [x == UNDETERMINED or y < m.reject_below for x, y in zip(said, score, strict=True)]]

        return work

    return map_texts(docs, {c: c for c in keep}, text_col, "lang_pred string, score double, rejected boolean", start)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are the text of no characters."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
