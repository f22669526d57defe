"""A funnel of cheap-to-expensive filters with counts per stage and reasons for rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.config import DEFAULTS
from tarnwork.functions.text import C_EXTENSIONS, contains_any, extension, strip

# Words of which one must occur in a message (as a substring, in any case).
KEYWORDS = [
    "performance", "optimize", "optimization", "speedup", "speed up", "speed-up", "fast", "faster", "fastest", "efficient", "efficiency", "throughput", "latency", "low-latency",
    "accelerate", "acceleration", "improve", "improvement", "enhance", "enhancement", "boost", "boosted", "tune", "tuning", "refactor for speed", "perf gain", "perf win",
    "reduce overhead", "reduce memory", "memory usage", "memory footprint", "memory consumption", "reduce allocation", "cache friendly", "cache efficiency", "cache hit", "cache miss",
    "inlining", "inline function", "loop unrolling", "vectorization", "vectorize", "simd", "parallelization", "parallelize", "multithreading", "multi-threading", "memoization", "lazy evaluation", "lock-free", "zero-copy", "hot path", "branch prediction", "prefetch",
    "bottleneck", "hotspot", "slow path", "critical path", "profile guided", "profiler", "complexity", "buffer reuse", "avoid copy", "avoid allocation", "reduce copy", "batch processing",
]


def one_file(c: str = "modified_files_count") -> Column:
    return F.coalesce(F.col(c) == 1, F.lit(False))


def first_file_is_c(c: str = "modified_files") -> Column:
    """The first file has an ending of C or C++; an empty or null list is not."""
    return F.coalesce(extension(F.get(F.col(c), F.lit(0))).isin(C_EXTENSIONS), F.lit(False))


def keyword_hit(c: str = "message", words: list[str] | None = None) -> Column:
    return F.coalesce(contains_any(F.col(c), KEYWORDS if words is None else words), F.lit(False))


def one_function(n: str = "modified_func_count", other: str = "modified_other") -> Column:
    return F.coalesce((F.col(n) == 1) & ~F.col(other), F.lit(False))


def strictly_true(c: str) -> Column:
    """The flag is set; null is not."""
    return F.coalesce(F.col(c), F.lit(False))


def has_text(c: str) -> Column:
    """Not null and not blank."""
    return F.coalesce(strip(F.col(c)) != "", F.lit(False))


def small_enough(kb: str, most: int = DEFAULTS.largest_repository_kb) -> Column:
    """At most so many KB; a missing size counts as 0."""
    return F.coalesce(F.col(kb), F.lit(0)) <= most


def well_formed(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows that have all fields that are needed."""
    return df.na.drop(subset=needed)


def not_excluded(c: str, names: list[str]) -> Column:
    """Not one of the names; null is none of them."""
    return ~F.coalesce(F.col(c).isin(names), F.lit(False)) if names else F.lit(True)


def with_both(df: DataFrame, blobs: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Rows of which the blobs have a text of every kind; rows with a null key have none."""
    has = F.lit(True)
    for k in kinds:
        has = has & F.max((F.col("kind") == k) & F.col("content").isNotNull())
    return df.join(blobs.groupBy(*keys).agg(F.coalesce(has, F.lit(False)).alias("_has")).where("_has").drop("_has"), keys, "left_semi")


def cumulative_stages(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Adds a boolean column per stage: whether the row passes it and all before it."""
    passed, cols = F.lit(True), {}
    for name, rule in stages:
        passed = passed & F.coalesce(rule, F.lit(False))
        cols[name] = passed
    return df.withColumns(cols)


def funnel_counts(df: DataFrame, group: str, stages: list[str]) -> DataFrame:
    """Rows of each group that reach each stage; partial sums leave each task, so a hot group does no harm."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("all_rows"), *[F.count_if(F.col(s)).alias(s) for s in stages])


def funnel_totals(counts: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, total, average, groups): per stage over the groups with a count; null counts are left out."""
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("long").alias("n")) for s in stages])).alias("x")).select("x.*")
    return long.groupBy("stage").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("average"), F.count("n").alias("groups"))


def blob_presence(blobs: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """(keys, has_<kind>..., missing): which kinds of text a key has, and the missing ones as text."""
    has = [F.coalesce(F.max((F.col("kind") == k) & F.col("content").isNotNull()), F.lit(False)).alias(f"has_{k}") for k in kinds]
    out = blobs.groupBy(*keys).agg(*has)
    return out.withColumn("missing", F.concat_ws(",", *[F.when(~F.col(f"has_{k}"), F.lit(k)) for k in kinds]))


def lookup_text(df: DataFrame, blobs: DataFrame, keys: list[str], kind: str, sentinel: str | None = None, output: str = "text") -> DataFrame:
    """Left join with the text of one kind; a missing one is null or the sentinel. The first content of a key by value."""
    one = blobs.where(F.col("kind") == kind).groupBy(*keys).agg(F.min("content").alias(output))
    out = df.join(one, keys, "left")
    return out if sentinel is None else out.withColumn(output, F.coalesce(output, F.lit(sentinel)))


def split_rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all rules, rows that do not with the names of the failed ones as ``reason``)."""
    failed = F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    marked = df.withColumn("reason", failed)
    return marked.where("reason = ''").drop("reason"), marked.where("reason <> ''")
