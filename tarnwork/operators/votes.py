"""Voting over repeated answers, central answers, coverage of strategies, best attempts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import ratio
from tarnwork.functions.vectors import norm


def majority_vote(df: DataFrame, keys: list[str], vote: str, attempt: str, explanation: str | None = None) -> DataFrame:
    """(keys, winner, votes, n, confidence[, explanation]): the commonest value, ties to the one seen first.

    Votes are counted per key and value before the winner is chosen. Null votes are none; a key without votes has no row. The
    explanation is that of the earliest attempt which voted for the winner.
    """
    aggs = [F.count(F.lit(1)).alias("votes"), F.min(attempt).alias("_seen")]
    if explanation:
        aggs.append(F.min_by(explanation, attempt).alias("_why"))
    per = df.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(*aggs)
    best = F.struct(F.col("votes"), -F.col("_seen"))
    out = per.groupBy(*keys).agg(F.max_by(vote, best).alias("winner"), F.max("votes").alias("votes"), F.sum("votes").alias("n"), *([F.max_by("_why", best).alias("explanation")] if explanation else []))
    return out.withColumn("confidence", F.round(F.col("votes") / F.col("n"), 6))


def strict_majority(df: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """(keys, passed): whether more than half of the votes are true; a tie is false."""
    return df.where(F.col(vote).isNotNull()).groupBy(*keys).agg((F.count_if(F.col(vote)) * 2 > F.count(vote)).alias("passed"))


def vote_with_na(df: DataFrame, keys: list[str], vote: str, attempt: str, asked: Column) -> DataFrame:
    """Majority of "true" and "false" answers, others left out; none: "false"; not asked: "NA"."""
    per = df.groupBy(*keys).agg(
        F.count_if(F.col(vote) == "true").alias("_t"), F.count_if(F.col(vote) == "false").alias("_f"),
        F.min(F.when(F.col(vote) == "true", F.col(attempt))).alias("_ft"), F.min(F.when(F.col(vote) == "false", F.col(attempt))).alias("_ff"), F.max(asked).alias("_asked"),
    )
    wins = (F.col("_t") > F.col("_f")) | ((F.col("_t") == F.col("_f")) & (F.col("_t") > 0) & (F.col("_ft") < F.col("_ff")))
    return per.select(*keys, F.when(~F.coalesce("_asked", F.lit(False)), "NA").when(wins, "true").otherwise("false").alias("winner"))


def _sum_of_units(df: DataFrame, group: str, unit: str) -> DataFrame:
    """(group, total): the sum of unit vectors, as partial sums of whole vectors before the shuffle."""
    sums = df.where(F.col(unit).isNotNull()).groupBy(group).agg(Summarizer.sum(array_to_vector(F.col(unit))).alias("_t"))
    return sums.select(group, vector_to_array("_t").alias("_total"))


def centrality(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Adds ``score``: mean cosine of a row to the others of its group, without pairing them.

    For unit vectors it is (v · Σv − v·v) / (n − 1). A group of one has 0; a zero vector has 0.
    """
    unit = F.transform(vector, lambda x: F.when(F.col("_norm") > 0, x.cast("double") / F.col("_norm")).otherwise(F.lit(0.0)))
    u = df.withColumn("_norm", norm(F.col(vector))).withColumn("_u", unit)
    total = _sum_of_units(u, group, "_u")
    n = u.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    dot = F.aggregate(F.zip_with("_u", "_total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.when(F.col("_norm") > 0, 1.0).otherwise(0.0)
    out = u.join(total, group).join(n, group).withColumn("score", F.when(F.col("_n") > 1, (dot - own) / (F.col("_n") - 1)).otherwise(0.0))
    return out.drop("_norm", "_u", "_total", "_n")


def medoid(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key, score): the row most like the others of its group; ties (to nine digits) to the smallest key."""
    s = centrality(df, group, key, vector).withColumn("_s", F.round("score", 9))
    return s.groupBy(group).agg(F.min_by(key, F.struct(-F.col("_s"), F.col(key))).alias(key), F.max("_s").alias("score"))


def cluster_profile(df: DataFrame, cluster: str, repository: str, generic: Column) -> DataFrame:
    """(cluster, size, generic_true, generic_false, generic_ratio, repositories): repositories is a map of counts."""
    per = df.withColumn("_g", generic).groupBy(cluster, repository).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_g")).alias("t"), F.count_if(~F.col("_g")).alias("f"))
    entries = F.array_sort(F.collect_list(F.when(F.col(repository).isNotNull(), F.struct(F.col(repository).alias("key"), F.col("n").alias("value")))))
    out = per.groupBy(cluster).agg(F.sum("n").alias("size"), F.sum("t").alias("generic_true"), F.sum("f").alias("generic_false"), F.map_from_entries(entries).alias("repositories"))
    return out.withColumn("generic_ratio", F.round(ratio(F.col("generic_true"), F.col("generic_true") + F.col("generic_false")), 6))


def coverage_totals(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row: commits, applicable pairs, own-cluster hits, commits with any hit, hits per commit.

    ``pairs``: cluster_id, commit, applicable. ``members``: cluster_id, commit (a commit's own cluster).
    """
    total = members.agg(F.count_distinct("commit").alias("total_commits"))
    hits = pairs.where("applicable").select("cluster_id", "commit").distinct()
    own = hits.join(members.distinct(), ["cluster_id", "commit"], "left_semi").agg(F.count(F.lit(1)).alias("own_hits"))
    sums = hits.agg(F.count(F.lit(1)).alias("total_applicable"), F.count_distinct("commit").alias("any_hits"))
    one = total.withColumn("_k", F.lit(1)).join(own.withColumn("_k", F.lit(1)), "_k").join(sums.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("average", F.round(ratio(F.col("total_applicable"), F.col("total_commits")), 6))


def coverage_by_cluster(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, applicable, applicable_ratio, members, own, other); clusters without an assessment have zeros."""
    commits = members.agg(F.count_distinct("commit").alias("_all")).first()[0]
    m = members.select("cluster_id", "commit").distinct()
    size = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    hits = pairs.where("applicable").select("cluster_id", "commit").distinct()
    n = hits.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("applicable"))
    own = hits.join(m, ["cluster_id", "commit"], "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("own"))
    out = size.join(n, "cluster_id", "full").join(own, "cluster_id", "left").na.fill(0, ["members", "applicable", "own"])
    return out.select("cluster_id", "applicable", F.round(ratio(F.col("applicable"), F.lit(commits)), 6).alias("applicable_ratio"), "members", "own", (F.col("applicable") - F.col("own")).alias("other"))


def coverage_histogram(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(n_strategies, commits) from 0 to the largest number of strategies of a commit, with true zeros."""
    per = members.select("commit").distinct().join(pairs.where("applicable").select("cluster_id", "commit").distinct(), "commit", "left").groupBy("commit").agg(F.count("cluster_id").alias("n"))
    counts = per.groupBy("n").agg(F.count(F.lit(1)).alias("commits"))
    span = counts.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.max("n"), F.lit(0).cast("long")))).alias("n"))
    return span.join(counts, "n", "left").select(F.col("n").alias("n_strategies"), F.coalesce("commits", F.lit(0)).alias("commits"))


def best_attempt(df: DataFrame, keys: list[str], attempt: str, good: Column, failed: Column) -> DataFrame:
    """The first good attempt without error of each key, else the first without error, else the first."""
    order = F.when(F.coalesce(good, F.lit(False)) & ~failed, 0).when(~failed, 1).otherwise(2)
    return df.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", attempt))).where("_n = 1").drop("_n", "_o")


def attempt_rates(df: DataFrame, good: Column, failed: Column) -> DataFrame:
    """One row: similar, different, errors, rate over attempts without error (0 for none)."""
    g, f = F.coalesce(good, F.lit(False)), F.coalesce(failed, F.lit(False))
    out = df.agg(F.count_if(g & ~f).alias("similar"), F.count_if(~g & ~f).alias("different"), F.count_if(f).alias("errors"))
    return out.withColumn("rate", F.round(ratio(F.col("similar"), F.col("similar") + F.col("different")), 6))


def best_rate(df: DataFrame, keys: list[str], attempt: str, good: Column, failed: Column) -> DataFrame:
    """One row (best_similar, best_valid, best_rate): of the best attempts without error, those that are similar."""
    best = best_attempt(df.select(*keys, attempt, F.coalesce(good, F.lit(False)).alias("_good"), F.coalesce(failed, F.lit(False)).alias("_failed")), keys, attempt, F.col("_good"), F.col("_failed"))
    out = best.agg(F.count_if(F.col("_good") & ~F.col("_failed")).alias("best_similar"), F.count_if(~F.col("_failed")).alias("best_valid"))
    return out.withColumn("best_rate", F.round(ratio(F.col("best_similar"), F.col("best_valid")), 6))
