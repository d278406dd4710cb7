import zlib

import pytest

from tesserae.llm import language_id as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs.where(L.fold("doc_id", 4) != 2), per_language=150)


def test_held_out_accuracy(docs, model):
    held = docs.where(L.fold("doc_id", 4) == 2)
    got = L.identify(held, model, keep=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_fold_is_crc32_of_the_id_as_text(docs):
    for r in docs.select("doc_id", L.fold("doc_id", 4).alias("f")).limit(50).collect():
        assert r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4


def test_undetermined_and_odd_rows(odd, empty, model):
    got = L.identify(odd, model).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] != 3:
            assert r["lang_pred"] in model.languages
    assert L.identify(empty, model).count() == 0
    nothing = L.fit(empty)
    assert {r["lang_pred"] for r in L.identify(odd, nothing).collect()} == {"und"}


def test_numerals_are_no_letters(spark, model):
    texts = ["½ ²", "①", "Ⅷ ٣", "½ the house of the", "12 !?", "ª"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(df, model).collect()}
    assert {k for k, v in got.items() if v == "und"} == {k for k, t in enumerate(texts) if not any(map(str.isalpha, t))} and got[3] == "en"


def test_sample_is_bounded_in_characters(docs):
    texts, labels = L.sample(docs, "doc_id", "text", "lang", 50, 20_000)
    assert sum(map(len, texts)) <= 20_000 and len(set(labels)) == 4


def test_low_confidence_is_rejected(spark, model):
    df = spark.createDataFrame([(1, "the of and with that in the house", None)], "doc_id long, text string, lang string")
    strict = L.LanguageModel(model.languages, model.scores, model.bias, model.temperature, 1.1)
    assert L.identify(df, strict).first()["rejected"] is True


def test_sample_is_bounded(docs):
    texts, labels = L.sample(docs, "doc_id", "text", "lang", 20, 10**8)
    assert all(labels.count(x) <= 20 for x in set(labels)) and len(set(labels)) == 4
    assert (texts, labels) == L.sample(docs.repartition(7), "doc_id", "text", "lang", 20, 10**8)


def test_subwords_share_stems():
    a, b = set(L.subwords("running", 1 << 15)), set(L.subwords("runner", 1 << 15))
    assert a & b and a != b


def test_the_whole_of_a_long_run_counts():
    model = L.train(["abab " * 30, "cdcd " * 30] * 60, ["ab", "cd"] * 60)
    texts = ["ab" * 20 + "cd" * 2000, "cd" * 20 + "ab" * 2000]
    assert [model.languages[int(model.probabilities(t).argmax())] for t in texts] == ["cd", "ab"]
    assert len(L.subwords("x" * 10_000, 1 << 15)) > 29_000
