"""Benchmark logs and comparisons in long form: (hash, side, run, bench, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics of which less or more is better.
LOWER_IS_BETTER = ["micros_per_op", "seconds"]
HIGHER_IS_BETTER = ["ops_per_sec", "MB_per_sec"]

# Result lines of the benchmark as they are taken, in its newer and its older format.
_NEW = r"^\s*(\w+)\s*:\s*([\d.,]+)\s*micros/op\s*([\d.,]+)\s*ops/sec\s*([\d.]+)\s*seconds\s*([\d,]+)\s*operations;*\s*([\d.]+)?\s*MB/s(?:\s*\((\d+) of (\d+) found\))?"
_OLD = r"^\s*(\w+)\s*:\s*([\d.,]+)\s*micros/op\s*([\d.,]+)\s*ops/sec;\s*([\d.]+)\s*MB/s(?:\s*\((\d+) of (\d+) found\))?"


def parse_db_bench(logs: DataFrame, text: str, old: bool = False) -> DataFrame:
    """Long form of the result lines of each log; of lines with one name the last counts. Other columns are kept.

    The format is chosen by ``old``, not by the text. Null and empty logs give no row.
    """
    names = ["micros_per_op", "ops_per_sec", "MB_per_sec", "found", "total_found"] if old else ["micros_per_op", "ops_per_sec", "seconds", "operations", "MB_per_sec", "found", "total_found"]
    pattern = _OLD if old else _NEW
    keep = [c for c in logs.columns if c != text]
    lines = logs.select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("_pos", "_line")).where(F.col("_line").rlike(pattern))
    values = [F.struct(F.lit(n).alias("metric"), F.expr(f"try_cast(regexp_replace(regexp_extract(_line, '{pattern.replace(chr(92), chr(92) * 2)}', {i + 2}), ',', '') AS double)").alias("value")) for i, n in enumerate(names)]
    got = lines.select(*keep, "_pos", F.regexp_extract("_line", pattern, 1).alias("bench"), F.array(*values).alias("v"))
    last = Window.partitionBy(*keep, "bench").orderBy(F.desc("_pos"))
    once = got.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return once.select(*keep, "bench", F.inline("v")).where("value IS NOT NULL")


def parse_redis(logs: DataFrame, text: str) -> DataFrame:
    """Long form of blocks that open with ====== NAME ======: throughput, and avg min p50 p95 p99 max two lines below the summary.

    A title that comes again starts its block anew; fewer than six latencies are left out. The lines of a log are an array, so
    nothing is shuffled: a block ends where the next title stands.
    """
    keep = [c for c in logs.columns if c != text]
    blocks = F.filter(F.split(text, r"(?m)^(?=[ \t]*======.*======\s*$)"), lambda b: b.rlike(r"^[ \t]*======.*======"))
    b = logs.select(*keep, F.posexplode(blocks).alias("_pos", "_b")).withColumn("bench", F.trim(F.regexp_replace(F.trim(F.regexp_extract("_b", r"^([^\n\r]*)", 1)), "^=+|=+$", "")))
    last = Window.partitionBy(*keep, "bench").orderBy(F.desc("_pos"))
    b = b.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    rates = F.regexp_extract_all("_b", F.lit(r"throughput summary:\s*([0-9.]+)\s*requests per second"), F.lit(1))
    throughput = F.try_element_at(rates, F.lit(-1)).try_cast("double")
    # of several rows of latencies the last that is one counts
    rows = F.regexp_extract_all("_b", F.lit(r"latency summary \(msec\):[^\n]*\n[^\n]*\n([^\n]*)"), F.lit(1))
    six = F.transform(rows, lambda r: F.transform(F.slice(F.split(F.trim(F.regexp_replace(r, r"\s+", " ")), " "), 1, 6), lambda x: x.try_cast("double")))
    numbers = F.coalesce(F.try_element_at(F.filter(six, lambda v: (F.size(v) == 6) & F.forall(v, lambda x: x.isNotNull())), F.lit(-1)), F.array().cast("array<double>"))
    names = ["avg", "min", "p50", "p95", "p99", "max"]
    entries = F.array(F.struct(F.lit("throughput").alias("metric"), throughput.alias("value")), *[F.struct(F.lit(n).alias("metric"), F.when(F.size(numbers) >= 6, F.get(numbers, F.lit(i))).alias("value")) for i, n in enumerate(names)])
    return b.select(*keep, "bench", F.inline(entries)).where("value IS NOT NULL")


def averages(long: DataFrame, keys: list[str], first_run_only_keys: bool = False) -> DataFrame:
    """Mean of each metric over runs, nulls left out; optionally only of metrics that the first run has."""
    out = long.groupBy(*keys, "bench", "metric").agg(F.avg("value").alias("value"), F.count("value").alias("runs"))
    if first_run_only_keys:
        first = long.where("run = 1").select(*keys, "bench", "metric").distinct()
        out = out.join(first, [*keys, "bench", "metric"], "left_semi")
    return out


def compare_sides(avg: DataFrame, keys: list[str], side: str, base: str, other: str) -> DataFrame:
    """(keys, bench, metric, base, other, pct_change): metrics that both sides have; base 0 gives null change."""
    a = avg.where(F.col(side) == base).select(*keys, "bench", "metric", F.col("value").alias("base"))
    b = avg.where(F.col(side) == other).select(*keys, "bench", "metric", F.col("value").alias("other"))
    both = a.join(b, [*keys, "bench", "metric"])
    return both.withColumn("pct_change", F.when(F.col("base") != 0, (F.col("other") - F.col("base")) / F.col("base") * 100))


def direction(metric: Column, base: Column, other: Column) -> Column:
    """better, worse or no change by the metric's direction; N/A for other metrics and missing values."""
    up, down = other > base, other < base
    return (
        F.when(base.isNull() | other.isNull(), "N/A")
        .when(metric.isin(LOWER_IS_BETTER), F.when(down, "better").when(up, "worse").otherwise("no change"))
        .when(metric.isin(HIGHER_IS_BETTER), F.when(up, "better").when(down, "worse").otherwise("no change"))
        .otherwise("N/A")
    )


def movement(base: Column, other: Column) -> Column:
    return F.when(other > base, "increased").when(other < base, "decreased").otherwise("no change")


def verdicts(compared: DataFrame, keys: list[str], tie: str = "no change") -> DataFrame:
    """(keys, bench, better, worse, verdict): the majority of metrics; equal counts above 0 follow ``tie``."""
    d = compared.withColumn("_d", direction(F.col("metric"), F.col("base"), F.col("other")))
    out = d.groupBy(*keys, "bench").agg(F.count_if(F.col("_d") == "better").alias("better"), F.count_if(F.col("_d") == "worse").alias("worse"))
    v = F.when(F.col("better") > F.col("worse"), "better").when(F.col("worse") > F.col("better"), "worse").when(F.col("better") > 0, F.lit(tie)).otherwise("no change")
    return out.withColumn("verdict", v)


def category(verdict: DataFrame, keys: list[str], benches: tuple[str, str]) -> DataFrame:
    """(keys, category): both_better, one_better_one_worse, both_worse, or uncategorised."""
    per = verdict.groupBy(*keys).agg(*[F.max(F.when(F.col("bench") == b, F.col("verdict"))).alias(f"_v{i}") for i, b in enumerate(benches)])
    b = (F.col("_v0") == "better").cast("int") + (F.col("_v1") == "better").cast("int")
    w = (F.col("_v0") == "worse").cast("int") + (F.col("_v1") == "worse").cast("int")
    return per.select(*keys, F.when(b == 2, "both_better").when(w == 2, "both_worse").when((b == 1) & (w == 1), "one_better_one_worse").otherwise("uncategorised").alias("category"))


CATEGORIES = ["both_better", "one_better_one_worse", "both_worse"]


def cross_table(df: DataFrame, a: str, b: str, values: list[str] = CATEGORIES) -> DataFrame:
    """(a, b, n) for all pairs of ``values``, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in values for y in values], f"{a} string, {b} string")
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def has_results(metrics: Column, benches: list[str]) -> Column:
    """Whether a map of bench to metrics has a non-empty map for each bench; null is false."""
    out = F.lit(True)
    for b in benches:
        out = out & (F.coalesce(F.size(F.element_at(metrics, F.lit(b))), F.lit(0)) > 0)
    return F.coalesce(out, F.lit(False))


def no_results(metrics: Column) -> Column:
    """Null or an empty map."""
    return metrics.isNull() | (F.size(metrics) == 0)


def explode_results(df: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """Long form of a map of bench to map of metric to value."""
    return df.select(*keys, F.explode(metrics).alias("bench", "_m")).select(*keys, "bench", F.explode("_m").alias("metric", "value"))
