"""Set joins by key: keep, drop, update, replace, append; duplicates and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.windows import first_per_key


def keep_known(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).distinct(), keys, "left_semi")


def drop_known(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other side does not have; rows with a null key stay."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def update_fields(df: DataFrame, source: DataFrame, keys: list[str], fields: list[str], order: list[str | Column]) -> DataFrame:
    """Fields of the first source row of a key, where it has them, else the row's own."""
    src = first_per_key(source.select(*keys, *fields), keys, order).select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(src, keys, "left")
    return out.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def replace_rows(df: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``newer`` take the place of rows with their key; keys that only ``newer`` has are not added."""
    return df.join(newer.select(*keys).distinct(), keys, "left_anti").unionByName(newer.join(df.select(*keys).distinct(), keys, "left_semi"), allowMissingColumns=True)


def append_new(existing: DataFrame, arriving: DataFrame, keys: list[str], defaults: dict[str, Column], order: list[str | Column]) -> DataFrame:
    """Existing rows as they are, and arriving rows of unseen keys (the first of each) with default fields."""
    new = first_per_key(arriving, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti").withColumns(defaults)
    return existing.unionByName(new, allowMissingColumns=True)


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that occur in all frames."""
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(key).distinct(), key, "left_semi")
    return out


def combine_with_missing(left: DataFrame, right: DataFrame, keys: list[str], mark: str = "found") -> DataFrame:
    """Left join that says of each row whether the right side has its key."""
    return left.join(right.withColumn(mark, F.lit(True)), keys, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedup_rates(df: DataFrame, deduped: DataFrame, group: str) -> DataFrame:
    """(group, original, kept, removed_pct) with a row for each group of ``df``, null included."""
    a = df.groupBy(group).agg(F.count(F.lit(1)).alias("original"))
    b = deduped.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("kept"))
    out = a.join(b, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("kept", F.coalesce("kept", F.lit(0))).drop("_g")
    return out.withColumn("removed_pct", F.round(100.0 * (F.col("original") - F.col("kept")) / F.col("original"), 6))


def pairs_not_done(left: DataFrame, right: DataFrame, done: DataFrame, keys: list[str], most_right: int = 10_000) -> DataFrame:
    """Every left row with every row of a small right side, except pairs already done.

    The right side is a catalogue of at most ``most_right`` rows, which is checked; it is exploded from one array, so that each
    left row yields its pairs where it is, without a shuffle.
    """
    rows = right.limit(most_right + 1).collect()
    if len(rows) > most_right:
        raise ValueError(f"more than {most_right} rows to pair with")
    spark = left.sparkSession
    small = spark.createDataFrame(rows, right.schema).agg(F.collect_list(F.struct(*right.columns)).alias("_all"))
    # one row: the array is a constant of the plan
    all_rows = small.first()["_all"] if rows else []
    if not rows:
        return left.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]).limit(0)
    array = F.array(*[F.struct(*[F.lit(r[c]).cast(right.schema[c].dataType).alias(c) for c in right.columns]) for r in all_rows])
    return left.withColumn("_r", F.explode(array)).select(*[F.col(c) for c in left.columns], *[F.col("_r")[c].alias(c) for c in right.columns]).join(done.select(*keys).distinct(), keys, "left_anti")


def range_first(points: DataFrame, spans: DataFrame, value: str, lo: str, hi: str, order: str, name: str, width: int) -> DataFrame:
    """For each point the name of the first span (by ``order``) that holds it, or null.

    Spans are cut into cells of ``width``; points and spans meet by equal cells, not by a loop over pairs.
    """
    cells = spans.select(lo, hi, order, name, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("_cell"))
    once = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_times"))  # equal points are looked up once, and kept as often as they came
    hit = once.withColumn("_cell", F.floor(F.col(value) / width)).join(cells, "_cell", "left").withColumn("_in", F.col(value).between(F.col(lo), F.col(hi)))
    found = hit.groupBy(*points.columns, "_times").agg(F.min_by(F.when(F.col("_in"), F.col(name)), F.when(F.col("_in"), F.col(order))).alias(name))
    return found.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_times")


def dedup_rate_total(rates: DataFrame) -> DataFrame:
    """One row (original, kept, removed_pct) over all groups of ``dedup_rates``; 0 for an empty table."""
    out = rates.agg(F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    return out.withColumn("removed_pct", F.round(F.when(F.col("original") > 0, 100.0 * (F.col("original") - F.col("kept")) / F.col("original")).otherwise(0.0), 6))


def join_versions(versions: dict[str, tuple[DataFrame, list[str]]], key: str, order: list[str | Column], shared: list[str]) -> DataFrame:
    """Keys that all versions of a table have, with the fields of each as ``<version>_<field>`` and the ``shared`` ones of the first.

    A version has one row a key, the first by ``order``.
    """
    out = None
    for name, (df, fields) in versions.items():
        keep = [F.col(f).alias(f"{name}_{f}") for f in fields]
        one = first_per_key(df, [key], order).select(key, *(shared if out is None else []), *keep)
        out = one if out is None else out.join(one, key)
    return out


def own_row(df: DataFrame, key: list[str], other: list[str], fields: list[str], prefix: str = "parent_") -> DataFrame:
    """Adds ``fields`` of the row whose ``key`` this row names in ``other`` (a child its parent); null if there is none."""
    src = first_per_key(df.select(*key, *fields), key, fields).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(f).alias(prefix + f) for f in fields])
    on = F.lit(True)
    for i, o in enumerate(other):
        on = on & (F.col(o) == F.col(f"_k{i}"))
    return df.join(src, on, "left").drop(*[f"_k{i}" for i in range(len(key))])


def lists_by_label(df: DataFrame, label: str, key: str) -> DataFrame:
    """(label, place, key): the members of each label in order of their key, as rows, so that no label need fit into one."""
    from tarnwork.operators.windows import rank_in_group

    return rank_in_group(df.select(label, key), [label], [key], "place").select(label, "place", key)
