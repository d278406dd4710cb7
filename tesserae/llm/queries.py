"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import fingerprint, language_id, line_dedup, mixing, ngram_join, oracles, pieces, pii, quality, sharding, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(documents(spark, sf_dir), disclosure=0.9, support=3).drop("found", "sanitised")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), "piece_bpe_32k.model", keep_ids=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir), threshold=0.8)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, ceiling=2).drop("source", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(language_id.fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (language_id.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "neighbours")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), n=5, threshold=0.8)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=8)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(language_id.fold("doc_id", 4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (language_id.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality": op3_quality,
        "op4_line_dedup": op4_line_dedup,
        "op5_mixing": op5_mixing,
        "op6_toxicity": op6_toxicity,
        "op7_ngram_join": op7_ngram_join,
        "op8_fingerprints": op8_fingerprints,
        "op9_sharding": op9_sharding,
        "op10_language_id": op10_language_id,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": oracles.PII, "op3_quality": oracles.QUALITY, "op4_line_dedup": oracles.LINE_DEDUP, "op7_ngram_join": oracles.NGRAM_JOIN, "op8_fingerprints": oracles.FINGERPRINTS}
