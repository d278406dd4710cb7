import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, extra=()):
    """Documents of these texts, with ids from 0, and the rows of ``extra``."""
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


#: Nulls, emptiness, white space, odd characters, ties and repeats.
ODD = [None, "", " ", "\n\n", "a", "\t x \x0b", "é́ 日本 𝒳   ▁", "word " * 3000, "same text here", "same text here", "x" * 5000, "1" * 300, "@ + . -", "+1 +1 +1", "."]


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    clash = [(None, "no id", None, None, None), (3, "an id again", None, "src1", 1), (100, "twice", "xx", "s", 5), (100, "twice", "xx", "s", 5)]
    df = make(spark, ODD, clash)
    for name in ("i", "t", "h", "k", "s", "w", "o", "n", "shard", "size", "copies", "score", "key", "n_words", "_gone"):
        df = df.withColumn(name, df.n_chars)
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
