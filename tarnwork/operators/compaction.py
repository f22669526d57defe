"""Consolidation of many tiny records or files into few well-sized files."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.staging import delete_path, fresh_path, path_exists, rename_path

#: Content bytes per output file, and sampled rows per output file for the boundaries.
TARGET_BYTES = 64 * 1024 * 1024
SAMPLE_PER_FILE = 400
#: Bounds of what reaches the driver: ranges, and sampled rows. A table of more files than ranges gets several files a range,
#: which are cut by rows.
MAX_RANGES, MAX_SAMPLE = 100_000, 1_000_000
_KEY, _BYTES = "__cluster_key", "__row_bytes"


def _free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until the table has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def byte_boundaries(keyed: DataFrame, n_files: int, rows: int, sample_per_file: int) -> np.ndarray:
    """Upper key bounds of ``n_files`` ranges of about equal bytes, from a bounded sample.

    The sample only places the boundaries; every row is written whatever it says.
    """
    share = min(1.0, min(sample_per_file * n_files, MAX_SAMPLE) / max(rows, 1))
    got = keyed.select(_KEY, _BYTES)
    if share < 1:
        got = got.sample(fraction=share, seed=7)
    pdf = got.toPandas().sort_values(_KEY, kind="stable")
    if pdf.empty or n_files < 2:
        return np.array([], dtype=object)
    cum = pdf[_BYTES].to_numpy(dtype="float64").cumsum()
    at = np.searchsorted(cum, cum[-1] * np.arange(1, n_files) / n_files)
    return np.unique(pdf[_KEY].to_numpy(dtype=object)[np.minimum(at, len(pdf) - 1)])


def compact(
    df: DataFrame,
    dest: str,
    *,
    row_id: str,
    cluster_by: Sequence[str],
    content: str,
    target_bytes: int = TARGET_BYTES,
    sample_per_file: int = SAMPLE_PER_FILE,
    first_by: Sequence[str | Column] = (),
) -> dict[str, int]:
    """Write each row of ``df`` once, range-partitioned by ``cluster_by``, into files of about ``target_bytes``.

    Rows are written to a staging folder, counted against the input there (rows, distinct ids, bytes, an
    order-free content checksum), and only then swapped in; on any difference the old folder stays.
    Repeated deliveries of an id and content are one row, the first by ``first_by`` and then by all columns. They share a range, so that
    contents are shuffled once; only if some of them differ in a clustering key they are made one beforehand. Null content, keys or ids are kept: a null key
    sorts first, a null id is one row per distinct content. A content above the target gets a file of its own
    range. An empty input gives an empty table. Returns the reconciled counts.
    """
    spark: SparkSession = df.sparkSession
    size = F.coalesce(F.octet_length(F.col(content)), F.lit(0))
    key = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cluster_by], F.coalesce(F.lpad(F.col(row_id).cast("string"), 20, "0"), F.lit("")))
    mark = F.xxhash64(F.col(row_id), F.col(content))
    # ids and hashes only: what must come out, counted without moving a content
    marks = df.select(F.col(row_id).alias("__id"), mark.alias("__mark"), size.alias("__size"), F.xxhash64(key).alias("__key")).groupBy("__id", "__mark", "__size").agg((F.min("__key") != F.max("__key")).alias("__moved"))
    sums = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("__size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.pmod("__mark", F.lit(1 << 31))), F.lit(0)).alias("checksum")]
    counted = marks.agg(*sums, F.count_if("__moved").alias("moved")).first()
    want = {k: counted[k] for k in ("rows", "bytes", "checksum")}
    n_files = max(1, ceil((want["bytes"] + 64 * want["rows"]) / target_bytes))
    n_ranges = min(n_files, MAX_RANGES)
    bounds = byte_boundaries(df.select(key.alias(_KEY), (size + 64).alias(_BYTES)), n_ranges, want["rows"], sample_per_file) if n_files > 1 else np.array([], dtype=object)
    m, k, b, r = _free(df, "__mark"), _free(df, "__key"), _free(df, "__bucket"), _free(df, "__first")
    order = [*first_by, *[F.xxhash64(c) for c in df.columns]]
    keyed = df.withColumn(m, mark)
    if counted["moved"]:
        keyed = keyed.withColumn(r, F.row_number().over(Window.partitionBy(row_id, m).orderBy(*order))).where(F.col(r) == 1).drop(r)
    keyed = keyed.withColumn(k, key)
    if len(bounds):
        shared = spark.sparkContext.broadcast(bounds)  # one string a file

        @F.pandas_udf("int")
        def bucket(k: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(shared.value, k.to_numpy(dtype=object), side="left").astype("int32"))

        placed = keyed.withColumn(b, bucket(k)).repartitionById(len(bounds) + 1, F.col(b))
    else:
        placed = keyed.withColumn(b, F.lit(0)).repartitionById(1, F.col(b))
    # a range is one task, where repeats lie side by side once it is sorted
    once = placed.withColumn(r, F.row_number().over(Window.partitionBy(b, k, m).orderBy(*order))).where(F.col(r) == 1)
    staged = fresh_path(spark, "compact")
    once.sortWithinPartitions(b, k, m).drop(b, k, m, r).write.option("compression", "zstd").option("maxRecordsPerFile", ceil(want["rows"] / n_files) if n_files > n_ranges else 0).parquet(staged)
    got = spark.read.parquet(staged).select(mark.alias("__mark"), size.alias("__size")).agg(*sums).first().asDict()
    if want != got:
        delete_path(spark, staged)
        raise RuntimeError(f"compaction lost or doubled records: {want} became {got}")
    old = f"{dest}.old"
    replaces = path_exists(spark, dest)
    if replaces:
        delete_path(spark, old)
        rename_path(spark, dest, old)
    if not rename_path(spark, staged, dest):
        if replaces:
            rename_path(spark, old, dest)
        raise RuntimeError(f"could not move {staged} to {dest}")
    delete_path(spark, old)
    return {"rows": got["rows"], "bytes": got["bytes"], "files": len(bounds) + 1}
