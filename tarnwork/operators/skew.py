"""Per-key results when a few keys hold most rows: eager aggregation through joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the flag states kept per join key: rows with the flag set, rows where it is not null.
_SET, _KNOWN = "_set", "_known"


def _state(df: DataFrame, keys: Sequence[str], row_id: str, flags: dict[str, F.Column], tag: str) -> DataFrame:
    """One compact row per join key: distinct rows and flag sums.

    The inner aggregation is on (keys, row_id), so that a hot key is spread over its ids;
    the outer one reduces map-side first, so that a hot key sends one row per task.
    """
    cols = {name: F.max(expr.cast("boolean")).alias(name) for name, expr in flags.items()}
    once = df.groupBy(*[F.col(k) for k in keys], F.col(row_id)).agg(F.lit(1).alias("_one"), *cols.values())
    sums = [F.count("_one").alias(f"{tag}_n")]
    for name in flags:
        sums += [F.count_if(F.col(name)).alias(name + _SET), F.count(name).alias(name + _KNOWN)]
    return once.groupBy(*keys).agg(*sums)


def eager_join_rollup(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    group: str,
    left_id: str,
    right_id: str,
    left_flags: dict[str, F.Column],
    right_flags: dict[str, F.Column],
) -> DataFrame:
    """Per ``group`` (one of ``keys``): distinct rows of both sides, flag rates, and joined pairs.

    Equivalent to deduplicating both sides on their id, full-outer-joining them on ``keys``
    and aggregating by ``group``, without ever materialising the join: both sides are reduced to
    one state per join key, states are joined, the pair count of a key is the product of its
    counts, and the states are summed to the group. A repeated row counts once.

    Defined results: a null key is a key of its own (it never joins: pairs 0); a group that
    only one side has gets zero counts for the other; a rate over no non-null flag is null;
    empty inputs give no row. Extra columns are ignored.
    """
    on = list(keys)
    l = _state(left.select(*on, left_id, *[e.alias(n) for n, e in left_flags.items()]), on, left_id, {n: F.col(n) for n in left_flags}, "l")
    r = _state(right.select(*on, right_id, *[e.alias(n) for n, e in right_flags.items()]), on, right_id, {n: F.col(n) for n in right_flags}, "r")
    # a union of both states rolled up by key is the full outer join of two one-row-per-key inputs
    both = l.unionByName(r, allowMissingColumns=True)
    names = [c for c in both.columns if c not in on]
    per_key = both.groupBy(*on).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    all_known = F.lit(True)
    for k in on:
        all_known = all_known & F.col(k).isNotNull()
    per_key = per_key.withColumn("pairs", F.when(all_known, F.col("l_n") * F.col("r_n")).otherwise(0))
    out = per_key.groupBy(group).agg(*[F.sum(c).alias(c) for c in [*names, "pairs"]])
    rates = [
        F.round(F.when(F.col(n + _KNOWN) > 0, F.col(n + _SET) / F.col(n + _KNOWN)), 6).alias(f"{n}_rate")
        for n in [*left_flags, *right_flags]
    ]
    return out.select(group, F.col("l_n").alias("n_left"), F.col("r_n").alias("n_right"), F.col("pairs").alias("n_pairs"), *rates)
