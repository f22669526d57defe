"""First-of, samples, slices and budgets. Every order is total: ties are broken by the columns given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.staging import stage


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column], keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key by ``order``. Rows with a null key are one group, or all kept with ``keep_null_keys``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    once = (df.where(known) if keep_null_keys else df).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.unionByName(df.where(~known)) if keep_null_keys else once


def rank_in_group(df: DataFrame, group: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in its group.

    Rows are put in ranges of (group, order), so that a large group lies in several; places within a range are then moved by
    the counts of the group's earlier ranges. No task holds a whole group.
    """
    p, i, b = (f"_{x}_{name}" for x in "pib")
    # staged: the ranges come from a sample and would differ if they were computed twice
    ranged = stage(df.repartitionByRange(*group, *order).withColumn(p, F.spark_partition_id()), "ranges")
    local = ranged.withColumn(i, F.row_number().over(Window.partitionBy(p, *group).orderBy(*order)))
    counts = local.groupBy(p, *group).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn(b, F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(p).alias("_p2"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], b)
    on = F.col(p) == F.col("_p2")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = local.join(before, on)
    return out.withColumn(name, (F.col(i) + F.col(b)).cast("int")).drop(p, i, b, "_p2", *[f"_g{k}" for k in range(len(group))])


def budgeted_pick(df: DataFrame, group: str, order: list[str], length: str, budget: int = 10, longest: int = 2000) -> DataFrame:
    """Walks each group in order and takes up to ``budget`` rows, skipping those longer than ``longest`` unless last.

    Adds ``picked`` (the place among the taken) and ``truncated``. A null length counts as 0. What can be taken is the first
    ``budget`` short rows and the last row, so that is all of a group that a task ever orders.
    """
    long = F.coalesce(F.col(length), F.lit(0)) > longest
    by = Window.partitionBy(group).orderBy(*order)
    short = df.where(~long).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= budget).drop("_n")
    last = df.groupBy(group).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_l")).select("_l.*").where(long)
    both = short.unionByName(last)
    return both.withColumn("picked", F.row_number().over(by)).where(F.col("picked") <= budget).withColumn("truncated", long)


def quota_sample(df: DataFrame, is_a: Column, quota: int, total: int, order_a: list[str | Column], seed_order: list[str | Column], extra: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The rows of ``extra``, of class A up to ``quota`` in all by ``order_a``, filled to ``total`` with rows of the other class by ``seed_order``.

    Rows whose ``keys`` are in ``extra`` are no candidates. What is left of class A does not fill up.
    """
    if extra is not None:
        df = df.join(extra.select(*(keys or df.columns)).distinct(), keys or df.columns, "left_anti")
        have, have_a = extra.agg(F.count(F.lit(1)), F.count_if(is_a)).first()
    else:
        have = have_a = 0
    a = df.where(is_a).orderBy(*order_a).limit(max(0, min(quota - have_a, total - have)))
    taken = a.count() + have
    out = a.unionByName(df.where(~is_a | is_a.isNull()).orderBy(*seed_order).limit(max(0, total - taken)))
    return out if extra is None else extra.select(*out.columns).unionByName(out)


def slices(df: DataFrame, order: list[str], size: int, parts: int) -> DataFrame:
    """Adds ``slice``: 0 for the first ``size`` rows in order, 1 for the next, the last slice taking the rest.

    Positions come from counts per range partition, so that no task holds the whole order.
    """
    # staged: the ranges come from a sample and would differ if they were computed twice
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)), "ranges")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rn = F.col("_b") + F.col("_i")
    return ranged.join(F.broadcast(before), "_p").withColumn("slice", F.least(F.floor(rn / size), F.lit(parts - 1)).cast("int")).drop("_p", "_i", "_b")


def first_success(df: DataFrame, group: str, order: str, ok: Column, value: str) -> DataFrame:
    """(group, value of the first row in order for which ``ok`` holds)."""
    return df.where(ok).groupBy(group).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def survival_curve(df: DataFrame, size: str) -> DataFrame:
    """(n, clusters): for each size that occurs, the number of groups of at least it. One row per size: a small window."""
    per = df.where(F.col(size).isNotNull()).groupBy(F.col(size).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return per.select("n", F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)).alias("clusters"))


def references_for(members: DataFrame, cluster: str, key: str, most: int = 3) -> DataFrame:
    """(cluster, key, reference, n): for each member up to ``most`` other members of its cluster, by a seeded order.

    The candidates are the first ``most`` + 1 of a cluster in that order, so the join stays linear in the members.
    """
    order = [F.md5(F.col(key).cast("string")), F.col(key)]
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(*order))
    pool = members.select(cluster, key).distinct().withColumn("rank", place).where(F.col("rank") <= most + 1).select(F.col(cluster).alias("_c"), F.col(key).alias("reference"), F.col("rank").alias("_r"))
    both = members.select(cluster, key).distinct().join(pool, (F.col(cluster) == F.col("_c")) & (F.col(key) != F.col("reference")))
    w = Window.partitionBy(cluster, key).orderBy("_r")
    return both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(cluster, key, "reference", "n")
