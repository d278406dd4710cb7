import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import toxicity as X
from tests.llm.conftest import make


def sparse(rows):
    """Vectors of dicts from term to weight."""
    return X.Vectors(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(int), np.array([t for r in rows for t in sorted(r)], dtype=int), np.array([r[t] for r in rows for t in sorted(r)]))


def brute(rows, index, query, k):
    """Cosines with all examples, in the index's order."""
    score = [sum(w * rows[i].get(t, 0.0) for t, w in query.items()) for i in index.order]
    order = sorted((p for p in range(len(score)) if score[p] > 1e-12), key=lambda p: (-round(score[p], 12), p))
    return [(score[p], p) for p in order[:k]]


@pytest.mark.parametrize("widest", [0, 5, 512])
def test_search_is_exact(widest):
    rng = np.random.default_rng(5)
    for size in (1, 63, 64, 65, 900):
        rows = []
        for _ in range(size):
            at = rng.choice(30, rng.integers(1, 6), replace=False)
            w = rng.choice([0.2, 0.5, 1.0], len(at))  # ties on purpose
            rows.append({int(t): float(x) for t, x in zip(at, w / np.sqrt((w**2).sum()), strict=True)})
        index = X.Index(sparse(rows), 30, widest=widest)
        queries = [*rows[:99], {}, {7: 1.0}]
        for k in (1, 7):
            cosine, place = index.nearest(sparse(queries), k)
            for q, c, p in zip(queries, cosine, place, strict=True):
                want = brute(rows, index, q, k)
                assert [x for x in p if x >= 0] == [x for _, x in want]
                assert np.allclose(c[p >= 0], [x for x, _ in want])


def test_no_example_is_no_neighbour():
    cosine, place = X.Index(sparse([]), 3).nearest(sparse([{1: 1.0}]), 4)
    assert (place == -1).all() and cosine.shape == (1, 4)


def test_scores_against_brute_force(spark, tables, model):
    """Cosines from the texts' own words, over all examples; votes and calibration as stated."""
    docs, labels = tables
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    texts = {r["doc_id"]: Counter(words(r["text"])) for r in docs.collect()}
    many = Counter(w for c in texts.values() for w in c)
    ids = [int(i) for i in model.ids]
    label = dict(zip(ids, model.labels, strict=True))
    n = [max(1, sum(1 for i in ids if label[i] == y)) for y in (0, 1)]
    have = [Counter(w for i in ids if label[i] == y for w in texts[i]) for y in (0, 1)]
    lean = {w for w, a in have[1].items() if a >= 4 and (a + 0.5) / (n[1] + 1) >= 6 * (have[0][w] + 0.5) / (n[0] + 1)}

    def vector(c):
        rarest = np.log(1 + len(texts)) + 1
        v = {w: (1 + np.log(k)) * (((np.log((1 + len(texts)) / (1 + many[w])) + 1) if w in have[0] or w in have[1] else rarest) * (6 if w in lean else 1)) for w, k in c.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = [vector(texts[i]) for i in ids]
    some = sorted(texts)[::400]
    got = {r["doc_id"]: r for r in X.score(docs.where(F.col("doc_id").isin(some)), model).collect()}
    for i in some:
        v = vector(texts[i])
        cosine = np.array([sum(x * e[w] for w, x in v.items() if w in e) for e in examples])
        order = sorted(np.flatnonzero(cosine > 1e-9), key=lambda p: (-round(cosine[p], 9), p))[:15]
        assert np.allclose([r["cosine"] for r in got[i]["neighbours"]], cosine[order])
        if order:
            w = cosine[order] ** 8 * model.weights[order]
            vote = ((w * model.labels[order]).sum() + 0.001 * model.prior) / (w.sum() + 0.001)
            same = [model.labels[p] for p in order if cosine[p] > 1 - 1e-9]
            want = (sum(same) + 0.05) / (len(same) + 0.1) if same else model.steps[1][max(0, np.searchsorted(model.steps[0], vote + 1e-12, side="right") - 1)]
            assert abs(got[i]["score"] - want) < 1e-6


def test_an_id_labelled_both_ways_counts_as_toxic(spark):
    docs = make(spark, ["one", "two words", "three more words"])
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    assert dict(zip(model.ids, model.labels, strict=True)) == {0: 1, 1: 0, 2: 0}


def test_copies_of_toxic_examples_of_rare_terms(spark):
    letters = "abcdefghij"
    rare = [f"please read {letters[k] * 5}o and {letters[k] * 5}u today" for k in range(6)]
    clean = [f"please read the news {letters[k % 10]}{letters[k // 10]} of today" for k in range(60)]
    docs = make(spark, [*rare, *clean, *rare])
    labels = spark.createDataFrame([(k, int(k < 6)) for k in range(66)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score(docs, X.fit(docs, labels)).collect()}
    assert all(got[k]["predicted"] == 1 and abs(got[k]["neighbours"][0]["cosine"] - 1) < 1e-9 for k in (*range(6), *range(66, 72)))
    assert all(got[k]["predicted"] == 0 and got[k]["neighbours"] for k in range(6, 66))


def test_monotone():
    x, y = X.monotone([0.1, 0.2, 0.2, 0.5, 0.9], [0, 1, 0, 0, 1], [1, 1, 1, 1, 1])
    assert list(x) == sorted(x) and list(y) == sorted(y)


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    return X.fit(docs, labels.where(X.fold("doc_id", 5) != 0))


def test_held_out_quality(tables, model):
    docs, labels = tables
    scored = X.score(docs, model).join(labels.where(X.fold("doc_id", 5) == 0), "doc_id").collect()
    pos, neg = [r["score"] for r in scored if r["toxic"] == 1], np.array([r["score"] for r in scored if r["toxic"] == 0])
    auc = np.mean([(neg < s).mean() + 0.5 * (neg == s).mean() for s in pos])
    assert auc > 0.9
    assert np.mean([r["predicted"] for r in scored if r["toxic"] == 0]) < 0.02
    assert np.mean([r["predicted"] for r in scored if r["toxic"] == 1]) > 0.7
    assert all(n["cosine"] > 0 for r in scored for n in r["neighbours"])


def test_odd_rows(odd, empty, model):
    got = X.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert X.score(empty, model).count() == 0


def test_without_labels(spark, odd, tables):
    none = tables[1].limit(0)
    m = X.fit(odd, none)
    assert {(r["score"], r["predicted"]) for r in X.score(odd, m).collect()} == {(0.0, 0)}


def test_null_labels_and_repeats(spark, odd):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, None), (8, 0), (9, 1), (100, 1), (None, 1)], "doc_id long, toxic int")
    m = X.fit(odd, labels)
    assert len(m.ids) <= 5 and X.score(odd, m).count() == odd.count()
