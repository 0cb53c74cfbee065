"""Incremental runs as streams: records that arrive are handled once, and counted by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_records(spark: SparkSession, folder: str, schema: str, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Parquet records that land in a folder, each key once within the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Handle all that is there and end; what is handled stays noted in the checkpoint, so a new run goes on from it."""

    def batch(df: DataFrame, number: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tumbling(stream: DataFrame, ts: str, by: list[str], size: str = "1 day", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Counts and sums by windows of event time."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("cnt"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "cnt", "total")
