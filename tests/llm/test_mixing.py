import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tesserae.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_fill_and_reshare():
    got = M.targets([("b", 100), ("a", 1000), (None, 10)], (5, 2, 1), 1.5, 2)
    # a weighs 5, b 2, null 1; of 1665 words null's share is above twice its size, b's too
    assert got["b"] == 200 and got[None] == 20 and got["a"] == pytest.approx(1665 - 220)


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets_law(sizes):
    named = [(f"s{k:02}", v) for k, v in enumerate(sizes)]
    got = M.targets(named, (5, 2, 1), 1.5, 2)
    assert all(-1e-9 <= got[s] <= 2 * v + 1e-6 for s, v in named)
    assert sum(got.values()) == pytest.approx(min(1.5, 2) * sum(sizes), rel=1e-9, abs=1e-6)
    free = [(got[s] / w) for (s, v), w in zip(named, [(5, 2, 1)[k % 3] for k in range(len(named))], strict=True) if got[s] < 2 * v - 1e-6]
    assert max(free, default=0) == pytest.approx(min(free, default=0))


def checked(df, rows):
    source = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2)
        source.setdefault((r["source"], r["source_size"], r["target"]), []).append(r)
    for (name, size, target), of in source.items():
        assert sum(r["size"] for r in of) == size, name
        largest = max(r["size"] for r in of)
        assert abs(sum(r["taken"] for r in of) - target) <= max(0.02 * target, min(largest, 3) + 1), (name, target)
    text = {}
    for r in df.collect():
        text.setdefault(r["doc_id"], set()).add(len(WORD.findall(r["text"] or "")))
    assert all(r["size"] in text[r["doc_id"]] for r in rows)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(df).collect()
    assert len(rows) == 1000
    checked(df, rows)
    again = M.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_long_documents_of_a_cut_source_are_tilted_down(spark):
    rows = [(k, "w " * (50 + 10 * (k % 40)), "a" if k < 200 else "b") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df, weights=(1, 9)).collect()
    cut = [r for r in got if r["source"] == "a" and r["target"] < r["source_size"]]
    short, long = [r["copies"] for r in cut if r["size"] < 200], [r["copies"] for r in cut if r["size"] > 300]
    assert cut and sum(short) / len(short) > sum(long) / len(long)


def test_odd_and_empty(odd, empty):
    rows = M.mix(odd).collect()
    assert len(rows) == odd.count()
    assert {r["source"] for r in rows} == {r["source"] for r in odd.collect()}
    assert M.mix(empty).count() == 0
