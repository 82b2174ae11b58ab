"""Incremental building: new chunk and span files are taken up once, in the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.upserts import upsert_mentions


def stream_mentions(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> None:
    """Count the mentions of all span files in ``source`` that haven't been read yet, and append the counts to ``target``.

    Each micro-batch writes the counts of its own spans under its batch number, so that a batch that is repeated after
    a failure overwrites itself; :func:`mentions` adds the batches up.
    """

    def write(batch: DataFrame, number: int) -> None:
        linked = batch.where("label IS NOT NULL AND canonical_name IS NOT NULL").select("label", F.col("canonical_name").alias("name"), "chunk_id")
        upsert_mentions(linked).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def mentions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("label", "name", "chunk_id").agg(F.sum("count").alias("count"))


def windowed_activity(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events and their value per window and type; works on a stream, where a watermark bounds the state, and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
