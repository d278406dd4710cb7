import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import pieces

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def enc():
    return pieces.encoder(pieces.resolve(MODEL))


def test_ids_match_the_library(enc):
    random.seed(3)
    letters = "ab e▁ \n\t日éthenrsio  <>0x1A.,'́𝒳​"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n for n in range(70)] + ["a" + " " * n + "b" for n in range(70)] + ["the" * 3000, "x" * 9000, "▁" * 40]
    for t in texts:
        assert enc.encode(t) == enc.library.encode(t), t[:60]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    e = pieces.encoder(pieces.resolve(MODEL))
    text = text.encode("utf-8", "ignore").decode()
    assert e.encode(text) == e.library.encode(text)
    assert e.decode(e.encode(text)) == e.library.decode(e.library.encode(text))


def test_backtracking_agrees_with_merging(enc):
    for word in ("▁unbelievable", "▁aaaaaaaaa", "▁thethethen", "▁ßäöü", "internationalisation"):
        assert enc.tokens(word) == enc.merged(word)


def test_memo_is_bounded():
    m = pieces.Memo(3)
    for k in range(20):
        m.put(k, k)
        assert len(m.young) + len(m.old) <= 6
    assert m.get(19) == 19 and m.get(0) is None


def test_table(spark, small, odd, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.resolve(MODEL))
    for df in (small, odd):
        got = sorted((tuple(r) for r in pieces.encode_decode(df, MODEL, keep_ids=False).collect()), key=repr)
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = lib.encode(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert pieces.encode_decode(empty, MODEL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert pieces.encode_decode(empty, MODEL).count() == 0


def test_memo_entries_are_small(enc):
    """A kept chunk is its ids as one string; kept pairs share their pieces' strings."""
    import tracemalloc

    random.seed(8)
    letters = "etaoinshrdlu"
    texts = [" ".join("".join(random.choice(letters) for _ in range(random.randint(4, 9))) for _ in range(100)) for _ in range(300)]
    enc.chunks, enc.pairs = pieces.Memo(), pieces.Memo()
    tracemalloc.start()
    for t in texts:
        enc.encode(t)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    kept = len(enc.chunks.young) + len(enc.pairs.young)
    assert kept > 20_000 and taken / kept < 150
    assert all(enc.encode(t) == enc.library.encode(t) for t in texts)
