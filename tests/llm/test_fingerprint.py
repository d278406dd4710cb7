import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import fingerprint as P


def edited(rows):
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"]), reverse=True)
    for k, r in enumerate(order):
        text, nxt = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        third = len(text) // 3
        yield r["doc_id"], text, text[: len(text) - third] + nxt[:third]


@pytest.mark.parametrize("bucket", [1, 7, 2000])
def test_next_document(spark, small, bucket):
    rows = small.select("doc_id", "text").collect()
    slim = small.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    got = {r["i"]: r["next_t"] for r in P.with_next(slim, "i", ["t"], "h", bucket).collect()}
    order = sorted(rows, key=lambda r: -r["doc_id"])
    assert got == {r["doc_id"]: order[(k + 1) % len(order)]["text"] for k, r in enumerate(order)}


def test_edits(spark, small):
    got = {r["doc_id"]: r for r in P.compare_edited(small).collect()}
    for i, text, change in edited(small.select("doc_id", "text").collect()):
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(change.encode()).hexdigest()
    assert sum(r["near_edited"] for r in got.values()) / len(got) > 0.5 > 0.1 > sum(r["near_next"] for r in got.values()) / len(got)
    by_text = {}
    for r in small.collect():
        by_text.setdefault(r["text"], set()).add(got[r["doc_id"]]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({y for x in by_text.values() for y in x}) == len(by_text)


def test_differing_sections_locate_an_edit(spark):
    lines = [f"line {k} has some words. And a second sentence.\n" for k in range(40)]
    other = [*lines]
    other[20] = "changed entirely.\n"
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string")
    a, b = P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))
    r = df.select(P.changed_sections(a, b).alias("s"), P.likeness(a, b).alias("l"), F.size(P.sections(a)).alias("n")).first()
    assert (r["s"], r["n"]) == ([1], 3) and 0.9 < r["l"] < 1


def test_root_is_the_merkle_root(spark):
    text = "One. Two!\nThree"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    paragraphs = [[sha("One. "), sha("Two!\n")], [sha("Three")]]
    section = sha(",".join(sha(",".join(p)) for p in paragraphs))
    said = spark.createDataFrame([(text,)], "t string").select(P.fingerprint(F.col("t"))).first()[0]
    assert said == f"{sha(section)}:{section[:12]}:" + ".".join(h[:12] for p in paragraphs for h in p)


def cuts(s):
    """What a sentence is parted into."""
    if len(s) <= 256:
        return [s]
    body = s.replace("\n", "").rstrip(" ")
    units = re.findall(r"[^ ]* |[^ ]+$", s) + ([""] if s.endswith(" ") else []) if " " in body else list(s)
    return "".join(u + "\n" * (hashlib.md5(u.encode()).hexdigest()[0] == "0" or i % 256 == 255) for i, u in enumerate(units)).split("\n")


@pytest.mark.parametrize("text", ["word " * 400, " ".join(f"w{k}" for k in range(500)) + "\n", "日本語テキスト" * 200, "x" * 1000, "".join(chr(0x4E00 + k * 7 % 3000) for k in range(900)), "a" * 256, "a b" * 100 + " \n"])
def test_pieces_of_long_sentences(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(P.pieces(F.col("t"))).first()[0]
    assert [x for x in got if x] == [x for x in cuts(text) if x] and "".join(got).replace("\n", "") == text.replace("\n", "")


def test_texts_without_a_sentence_end_keep_their_unchanged_pieces(spark):
    words = [f"w{k * 7919 % 1000}" for k in range(600)]
    kanji = "".join(chr(0x4E00 + k * 7919 % 5000) for k in range(2000))
    for a, b in ((" ".join(words), " ".join(words[:300] + ["changed"] + words[301:])), (kanji, kanji[:900] + "X" + kanji[900:])):
        r = spark.createDataFrame([(a, b)], "a string, b string").select(P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b")))).first()[0]
        assert 0.85 < r < 1


def test_ids_are_whole_numbers(small):
    with pytest.raises(TypeError):
        P.compare_edited(small.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_odd_and_empty(odd, empty):
    rows = P.compare_edited(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert P.compare_edited(empty).count() == 0
    one = P.compare_edited(odd.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0
