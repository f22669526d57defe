"""Writers: JSON arrays per partition, sorted CSV, one text a row, resumable result tables, reject logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.staging import path_exists


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with header, sorted over all files by range partitions, so that no single task writes everything."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """Text rows in a folder per value of ``name``."""
    df.select(F.col(name), F.coalesce(F.col(text), F.lit("")).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def write_rejects(rejected: DataFrame, path: str, key: str) -> None:
    """Lines "key: reason"."""
    rejected.select(F.concat_ws(": ", F.col(key).cast("string"), F.col("reason")).alias("value")).write.mode("overwrite").text(path)


def resume(spark: SparkSession, todo: DataFrame, keys: list[str], path: str, work: Callable[[DataFrame], DataFrame], batches: int = 1) -> DataFrame:
    """Appends the results of rows whose key the result table lacks, in ``batches`` slices; a killed run goes on where it stopped."""
    for b in range(batches):
        part = todo if batches == 1 else todo.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == b)
        if path_exists(spark, path):
            part = part.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
        work(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)
