import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tesserae.llm import line_dedup as D
from tests.llm.conftest import make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, threshold=Fraction(4, 5)):
    """Every line against every earlier one."""
    seen, gone = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((text or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if not s:
                continue
            if any(len(s & t) >= threshold * len(s | t) for t in seen):
                gone.setdefault(i, []).append(p)
            seen.append(s)
    return gone


def check(df, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows)
    for r in D.report(df, **how).collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert (r["n_lines"], r["removed_lines"]) == (len(text.split("\n")), ",".join(map(str, want.get(r["doc_id"], [])))), r["doc_id"]


def test_documents(small):
    check(small)


@pytest.mark.parametrize("bits", [2, 16])
def test_made_lines(spark, bits):
    random.seed(bits)
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(random.randint(1, 6)):
            n = random.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 20, 30])
            words = [f"w{min(int(random.expovariate(0.15)), 45)}" for _ in range(n)]
            lines.append(" ".join(words))
            if random.random() < 0.5:  # a variant: words added, dropped or replaced
                v = words[:]
                for _ in range(random.randint(1, 3)):
                    v[random.randrange(len(v))] = f"w{random.randrange(60)}"
                lines.append(" ".join(v + [f"w{random.randrange(60)}"] * random.randint(0, 2)))
        texts.append("\n".join(lines))
    check(make(spark, texts), bits=bits)


@pytest.mark.parametrize("few", [1, 5, 64])
def test_a_group_of_variants(spark, few):
    words = [f"c{k}" for k in range(40)]
    texts = [" ".join(words[:j] + [f"n{j}"] + words[j + 1 :]) for j in range(40)] + [" ".join(words[: 40 - j]) for j in range(25)]
    check(make(spark, texts), bits=12, few=few)


def test_text_without_the_removed_lines(spark):
    df = make(spark, ["one two three\nfour five six seven", "one two three\nnew line here", None, "", "one two three"])
    got = {r["doc_id"]: r["text"] for r in D.dedup(df, bits=10).collect()}
    assert got == {0: "one two three\nfour five six seven", 1: "new line here", 2: None, 3: "", 4: ""}


def test_odd_and_empty(odd, empty):
    out = D.dedup(odd, bits=10)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert D.report(odd, bits=10).count() == odd.count()
    assert D.dedup(empty, bits=10).count() == 0


def test_lines_of_one_and_two_words_and_any_white_space(spark):
    texts = ["Les.\nyes no\n-", "no yes\nLes.\n \t\x0b", "one\ttwo\x0cthree\rfour", "日本語日本語\n\n日本語日本語", "  four three two  one ", "yes\tyes no"]
    check(make(spark, texts), bits=12)
    got = {r["doc_id"]: r["removed_lines"] for r in D.report(make(spark, texts), bits=12).collect()}
    assert got == {0: "", 1: "0,1", 2: "", 3: "2", 4: "0", 5: "0"}


def test_large_tables_take_the_same_way(small, spark):
    """With nothing counted as small, rows meet by shuffling; results stay."""
    say = lambda **how: sorted(map(tuple, D.report(small, **how).collect()))
    assert say(small=0) == say()


def test_ids_are_whole_numbers(small):
    with pytest.raises(TypeError):
        D.report(small.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_low_thresholds_are_refused(small):
    with pytest.raises(ValueError):
        D.report(small, threshold=0.5)


def test_words_hashes_cannot_be_null(spark):
    """Else sorting and telling them apart boxes every word, which costs op4 much of its time."""
    kind = spark.range(1).select(D.hashes(F.lit(" a  b ")).alias("x"), D.hashes(F.lit("")).alias("y")).schema
    assert not kind["x"].dataType.containsNull and not kind["y"].dataType.containsNull


def test_the_report_reads_texts_no_more_than_the_join(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    make(spark, ["one two three", "one two three\nfour five six", None]).write.parquet(path)
    out = D.report(spark.read.parquet(path), bits=10)
    assert not [f for f in out.inputFiles() if "documents.parquet" in f]
    assert {tuple(r) for r in out.collect()} == {(0, 1, 0, ""), (1, 2, 1, "0"), (2, 1, 0, "")}


def test_repeated_rows_and_narrow_ids(spark):
    """Repeated rows count once, and each is reported; ids keep their type."""
    line = [f"w{k}" for k in range(12)]
    texts = [" ".join(line), "\n".join([" ".join([*line[:11], "other"]), "", "short one"]), "short one\n" + " ".join([*line, "more"])]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *rows, (None, None, None, None, 0)], "doc_id int, text string, lang string, source string, n_chars long")
    out = D.report(df, bits=12)
    assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert sorted(map(tuple, out.where("doc_id is not null").collect())) == sorted([(0, 1, 0, ""), (1, 3, 1, "0"), (2, 2, 2, "0,1")] * 2)
    assert [tuple(r) for r in out.where("doc_id is null").collect()] == [(None, 1, 0, "")]


def test_texts_without_any_word(spark):
    assert {tuple(r) for r in D.report(make(spark, ["", None, " \t\n"]), bits=10).collect()} == {(0, 1, 0, ""), (1, 1, 0, ""), (2, 2, 0, "")}


def test_texts_are_split_once_and_few_lambdas_run_for_each_word(spark, monkeypatch):
    """Splitting, and lambdas, which aren't compiled, cost op4 most of its time."""
    plans, kept = {}, D.cut

    def cut(df, label, **options):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, label, **options)

    monkeypatch.setattr(D, "cut", cut)
    out = D.report(make(spark, ["one\ttwo three", "three two one\n", None]), bits=10)
    assert {tuple(r) for r in out.collect()} == {(0, 1, 0, ""), (1, 2, 1, "0"), (2, 1, 0, "")}
    assert "split(" not in plans["lines-sketch"] and "split(" not in plans["lines"] and "filter(" not in plans["lines"]
