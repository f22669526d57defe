"""Projections: dropping, wrapping, defaults, comparison rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without those of ``columns`` that the table has."""
    return df.drop(*[c for c in columns if c in df.columns])


def wrap_scalars(df: DataFrame, columns: list[str], drop: list[str] | None = None) -> DataFrame:
    """Each of ``columns`` as an array of one element (none for null), without the columns ``drop``."""
    one = {c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast(f"array<{df.schema[c].dataType.simpleString()}>")) for c in columns}
    return drop_present(df.withColumns(one), drop or [])


def with_defaults(df: DataFrame, fields: dict[str, tuple[str, Column]]) -> DataFrame:
    """Columns {name: (path of a nested field, what stands for null)}."""
    return df.select(*[F.coalesce(F.col(path), default).alias(name) for name, (path, default) in fields.items()])


def comparison_rows(long: DataFrame, key: str, side: str, benches: tuple[str, str], parent: str, child: str, other: str) -> DataFrame:
    """One row a key of averages in long form (key, side, bench, metric, value): what each side has, and how the sides compare.

    (key, can_run, parent_to_child, parent_to_other, child_to_other, parent_to_child_with_other, average_parent, average_child,
    average_other): the comparisons are categories of both benches, null where a side has no averages; the averages are maps.
    """
    from tarnwork.operators import perf

    entry = F.struct(F.concat_ws("/", "bench", "metric").alias("key"), F.col("value").alias("value"))
    sides = {"parent": parent, "child": child, "other": other}
    averages = long.groupBy(key).agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(side) == v, entry)))).alias(f"average_{n}") for n, v in sides.items()])
    out = averages
    for name, (a, b) in {"parent_to_child": (parent, child), "parent_to_other": (parent, other), "child_to_other": (child, other)}.items():
        got = perf.category(perf.verdicts(perf.compare_sides(long, [key], side, a, b), [key]), [key], benches)
        out = out.join(got.withColumnRenamed("category", name), key, "left")
    has_other = F.size("average_other") > 0
    return out.select(
        key, has_other.alias("can_run"), "parent_to_child", "parent_to_other", "child_to_other", F.when(has_other, F.col("parent_to_child")).alias("parent_to_child_with_other"),
        "average_parent", "average_child", "average_other",
    )
