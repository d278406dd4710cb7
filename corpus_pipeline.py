"""A training-data pipeline of five stages, each written as Parquet and reread as the next one's documents.

Toxic documents go; of lines that repeat earlier ones the later go; of documents that links of near copies join, the
one of least id stays; sources are mixed to target weights, a document standing as often as the mix takes it; and the
remaining texts are encoded and decoded. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import language_id, line_dedup, mixing, ngram_join, pieces, toxicity
from tesserae.storage import cut, settle

def plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns that nothing clashes with, the id as ``id``, and what gives them their names back."""
    names = {c: "id" if c == "doc_id" else f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(to) for c, to in names.items()]), [F.col(to).alias(c) for c, to in names.items()]


def counted(table: DataFrame, small: int = 1_000_000) -> DataFrame:
    """A table from ``cut``, to be broadcast if it has few rows, so that texts aren't sent; else joined by shuffling."""
    return F.broadcast(table) if table.count() <= small else table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of the batches in which tasks exchange rows with Python workers, and Spark's name for their bound.
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_bytes(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of at most about ``BATCH`` bytes (one row at least), as tasks and
    workers each hold whole batches beside their own memory. Spark bounds them by 64 MB and 10,000 rows. The session
    keeps the setting, as a stage's rows are asked for after it has returned; a lower bound of the user's stays."""
    now = spark.conf.get(BATCH_BYTES, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def settled(stage: Stage) -> Stage:
    """The stage, begun when the driver has given back what earlier ones held, its rows sent to Python in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        batch_bytes(spark)
        settle(spark)
        out = stage(spark, docs, sf_dir)
        settle(spark)
        return out

    return run_stage


@settled
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model learns from the labels that op6 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(language_id.fold("doc_id", 5) != 0))
    rows, back = plain(docs)
    text = f"c{docs.columns.index('text')}"
    scored = toxicity.score(rows, model, text_col=text, keep=tuple(rows.columns), evidence=False)
    return scored.where("predicted = 0").select(*back)


@settled
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of Jaccard similarity 0.8 or more with an earlier line go; documents stay, be they empty then."""
    return line_dedup.dedup(docs, threshold=0.8)


@settled
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five words, similarity 0.8) the one of least id stays, once. Rows without an id
    stay; so do, if any of them does, rows of one id whose texts differ."""
    groups = ngram_join.join(docs, n=5, threshold=0.8)
    groups = cut(groups, "pipeline-groups")
    stay = counted(cut(groups.where("doc_id <=> class_id").select(F.col("doc_id").alias("stays")).distinct(), "pipeline-stay"))
    rows, back = plain(docs)
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stays")), "left_semi")
    again = cut(groups.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1 and again is not null").select("again"), "pipeline-again")
    if not again.isEmpty():  # only rows whose id repeats are sent anywhere
        same = F.col("id").eqNullSafe(F.col("again"))
        kept = kept.join(counted(again), same, "left_anti").unionByName(kept.join(counted(again), same, "left_semi").dropDuplicates(["id", f"c{docs.columns.index('text')}"]))
    return kept.select(*back)


@settled
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating, and share 1.5 times all words; a row for each copy. Rows of one id all stand as
    often as the one taken most."""
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, ceiling=2)
    copies = cut(mixed.groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0"), "pipeline-copies")
    rows, back = plain(docs)
    both = rows.join(counted(copies), F.col("id").eqNullSafe(F.col("doc_id")))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back)


@settled
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and digests of ids and decoded texts."""
    return pieces.encode_decode(docs, "piece_bpe_32k.model", keep_ids=True).select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express nearest-neighbour scores or merge-type encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
