"""Resumable incremental processing: a file stream merged into a result table by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from tarnwork.staging import path_exists


def stream_upsert(spark: SparkSession, source: str, schema, keys: list[str], target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch appends the rows of unseen keys to ``target``; rows of one key in a batch are one.

    A batch that is run again after a failure adds nothing twice: it is told by its keys.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(keys)
        if path_exists(spark, target):
            new = new.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        work(new).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, time: str, window: str, delay: str, group: str) -> DataFrame:
    """(beyond batch parity) counts and sums per window and group; rows later than ``delay`` are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, delay: str, group: str) -> DataFrame:
    """(beyond batch parity) sessions of a group that end after a gap."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")
