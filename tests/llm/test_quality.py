import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(df, rows):
    wanted = {}
    for r in df.select("doc_id", "text").collect():
        wanted.setdefault(r["doc_id"], set()).add(base(r["text"] or ""))
    for r in rows:
        assert tuple(r[n] for n in NAMES) in wanted[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = Q.assess(docs).collect()
    check(docs, rows)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [r for r in rows if not r["base_failed"] and r["doc_id"] in quality]
    good, bad = [r for r in judged if quality[r["doc_id"]] == 1], [r for r in judged if quality[r["doc_id"]] == 0]
    assert sum(r["kept"] for r in good) / len(good) > 0.99
    assert sum(r["kept"] for r in bad) / len(bad) < 0.35


def test_odd_and_empty(odd, empty):
    rows = Q.assess(odd).collect()
    assert len(rows) == odd.count()
    check(odd, rows)
    assert Q.assess(empty).count() == 0


@pytest.mark.parametrize("words", [["a", "b", "c"] * 70, [f"w{k % 90}" for k in range(400)], ["x"] * 100, [f"u{k}" for k in range(50)] + ["p", "q", "r", "p", "q", "r"]])
def test_repeats_by_either_way(spark, words):
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    assert df.select(Q.repeat_words(F.split("t", " "))).first()[0] == base(" ".join(words))[4]


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    got = df.select(Q.total(F.transform(F.arrays_zip("p", "q"), lambda z: Q.share_part(z["p"], z["q"]))) / 2).first()[0]
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    assert got == pytest.approx((kl(p, m) + kl(q, m)) / 2)


def test_word_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],)], "w array<string>")
    assert [tuple(x) for x in df.select(Q.counts_of(F.col("w"), ["a", "b", "z"])).first()[0]] == [("a", 1), ("b", 3)]
