import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tesserae.llm import ngram_join as J
from tesserae.llm.graph import components
from tests.llm.conftest import make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links, root = Counter(), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if (not s and not t) or (s and t and 5 * len(s & t) >= 4 * len(s | t)):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets))


def check(df, **how):
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted(map(tuple, J.join(df, **how).collect())) == want


def test_documents(small):
    check(small)


def near_copies(spark, many=90):
    random.seed(4)
    text = [f"w{random.randrange(4000)}" for _ in range(200)]
    out = []
    for k in range(many):
        t = text[:]
        for _ in range(k % 9):
            t[random.randrange(len(t))] = f"x{k}-{random.randrange(99)}"
        out.append(" ".join(t))
    return make(spark, out + out[:10] + ["", None, " ", "a b", "a b", "b a", "a b c d e", "a b c d e f"])


@pytest.mark.parametrize("block", [2048, 20])
def test_near_copies(spark, block):
    check(near_copies(spark), block=block)


def test_pairs_are_exact_on_either_way():
    rng = np.random.default_rng(2)
    for m in (3, 5, 40):
        core = rng.choice(1000, 60, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(core, 55, replace=False), rng.choice(5000, rng.integers(0, 12)) + 2000])).astype(np.uint64) for _ in range(m)]
        left = np.arange(m) % 2 == 0
        for sides in (np.ones(m, dtype=bool), left):
            i, j = J.similar_pairs(sets, sides, Fraction(4, 5))
            got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
            want = {(a, b) for a in range(m) for b in range(a + 1, m) if (sides.all() or sides[a] != sides[b]) and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
            assert got == want and len(i) == len(got)


def labels_of(spark, sets, trees, longest):
    hashes = J.MinHash(trees * longest)
    rows = []
    for k, words in enumerate(sets):
        sig = hashes.signature(J.shingle_sets([" ".join(words)], 1)[0])
        rows += [(k, t, bytearray(sig[4 * longest * t : 4 * longest * (t + 1)])) for t in range(trees)]
    return spark.createDataFrame(rows, "hub long, tree int, label binary")


def test_forest_stops_where_links_are_met_and_goes_on_where_they_are_not(spark):
    """Copies that differ in little meet at the longest prefix; pairs at the threshold need the shortest."""
    words = [[f"g{k}w{j}" for j in range(200)] for k in range(40)]
    close = words + [w[:-1] + [f"x{k}"] for k, w in enumerate(words)]
    far = words + [w[:-21] + [f"x{k}y{j}" for j in range(21)] for k, w in enumerate(words)]
    stars, depth = J.forest(labels_of(spark, close, 24, 6), 24, 6, 0.8, 0.99999)
    assert depth == 6 and {(r["a"], r["b"]) for r in stars.distinct().collect()} == {(k + 40, k) for k in range(40)}
    stars, depth = J.forest(labels_of(spark, far, 24, 6), 24, 6, 0.8, 0.99999)
    assert depth == 4 and {(r["a"], r["b"]) for r in stars.distinct().collect()} >= {(k + 40, k) for k in range(40)}


def test_only_the_least_class_of_a_node_goes_on(spark):
    label = lambda *x: bytearray(b"".join(v.to_bytes(4, "big") for v in x))
    rows = [(1, 0, label(1, 1, 1)), (2, 0, label(1, 1, 1)), (3, 0, label(1, 1, 2)), (4, 0, label(1, 1, 2)), (5, 0, label(9, 9, 9))]
    rows += [(k, 1, label(k, k, k)) for k in range(1, 6)]  # nothing meets in the other tree, so half the chances are unmet
    stars, depth = J.forest(spark.createDataFrame(rows, "hub long, tree int, label binary"), 2, 3, 0.8, 0.8)
    assert depth == 2 and sorted(map(tuple, stars.collect())) == [(2, 1), (3, 1), (4, 3)]


def test_prefix_is_shortened_until_recall():
    assert J.depth_for(0.99999, 0.8, 24, 5) == 4
    for recall in (0.5, 0.9, 0.999):
        d = J.depth_for(recall, 0.8, 24, 12)
        assert 1 - (1 - 0.8**d) ** 24 >= recall > (1 - (1 - 0.8 ** (d + 1)) ** 24 if d < 12 else 0)
    with pytest.raises(ValueError):
        J.depth_for(0.999999, 0.1, 2, 3)


def test_odd_and_empty(odd, empty):
    assert J.join(odd).count() == odd.count()
    assert J.join(empty).count() == 0


def test_components(spark):
    edges = [(9, 7), (7, 5), (5, 3), (20, 21), (3, 3), (21, 22), (22, 20), (100, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 3, 7: 3, 5: 3, 3: 3, 100: 3, 20: 20, 21: 20, 22: 20}
    path = [(k + 1, k) for k in range(200)]
    assert {r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
