"""Keeping a snapshot current from a stream of file states, by micro-batches of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators import incremental

STATE = "root string, path string, mtime double, size long, content_hash string"


def states(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of file states (Parquet files dropped into a folder)."""
    return spark.readStream.schema(STATE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def follow(stream: DataFrame, snapshot: str, checkpoint: str, tool_version: str = "1", **trigger) -> StreamingQuery:
    """Apply each batch to the snapshot: the newest state of each file replaces what was there. Versions are written
    beside each other by batch number, so a batch that is run again after a failure gives the same version."""
    spark = stream.sparkSession

    def version(n: int) -> str:
        return f"{snapshot}/v={n}"

    def previous(n: int) -> DataFrame:
        for k in range(n - 1, -1, -1):
            try:
                return spark.read.parquet(version(k))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return spark.createDataFrame([], STATE + ", tool_version string")

    def apply(batch: DataFrame, number: int) -> None:
        fields = [c.split()[0] for c in STATE.split(", ")]
        newest = batch.groupBy("root", "path").agg(F.max_by(F.struct(*fields), F.struct("mtime", "content_hash")).alias("s")).select("s.*")
        merged = incremental.upsert(previous(number), newest.withColumn("tool_version", F.lit(tool_version)))
        merged.write.mode("overwrite").parquet(version(number))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
