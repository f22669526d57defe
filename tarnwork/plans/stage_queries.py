"""Queries over the stages made of completions, with answers as stored in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import stages
from tarnwork.operators.completions import TASKS
from tarnwork.plans.analysis_queries import _ANSWERS, _KNN, answers, embeddings, knn
from tarnwork.plans.registry import Registry
from tarnwork.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_VOTES = """WITH s AS (SELECT DISTINCT commit_id, optimization_summary AS o, is_generic_optimization AS g FROM summary_commit), v AS (SELECT commit_id, o[k] AS o, g[k] AS g, k FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM s) WHERE o[k] IS NOT NULL),
t AS (SELECT commit_id, count(*) AS n, count(*) FILTER (coalesce(g, false)) AS t, count(*) FILTER (NOT coalesce(g, false)) AS f, arg_min(coalesce(g, false), k) AS first FROM v GROUP BY 1)"""


def _summaries(spark, d):
    s = table(spark, d, "summary_commit").select("commit_id", "message", F.col("optimization_summary").alias("o"), F.col("is_generic_optimization").alias("g")).distinct()
    one = s.select("commit_id", F.posexplode("o").alias("k", "o"), "g").where("o IS NOT NULL")
    stored = one.select("commit_id", (F.col("k") + 1).alias("attempt"), F.concat(F.lit("Summary: "), "o", F.lit("\nGeneric: "), F.coalesce(F.get("g", F.col("k")), F.lit(False)).cast("string")).alias("content"))
    return s.select("commit_id", "message"), stored


@query("summary_votes", _VOTES + " SELECT commit_id, CASE WHEN t.t > t.f OR (t.t = t.f AND t.first) THEN true ELSE false END AS generic, n FROM t")
def summary_votes(spark, d):
    df, stored = _summaries(spark, d)
    return stages.summarise(df, ["commit_id"], stages.replaying({"summarise_commit": stored})).select("commit_id", "generic", "n")


@query("summary_top_up", _VOTES + " SELECT commit_id, t.t * 2 > n AS generic, n FROM t")
def summary_top_up(spark, d):
    """The first two attempts are there already; the others are asked for."""
    df, stored = _summaries(spark, d)
    ask = stages.replaying({"summarise_commit": stored})
    have = ask(df, ["commit_id"], TASKS["summarise_commit"], None).where("status = 'success' AND attempt <= 2").select("commit_id", "attempt", "summary", "generic")
    return stages.summarise(df, ["commit_id"], ask, have, strict=True).select("commit_id", "generic", "n")


@query("summaries_until_agreed", "SELECT DISTINCT commit_id FROM summary_commit WHERE len([x FOR x IN optimization_summary[1:5] IF x IS NOT NULL]) > 0")
def summaries_until_agreed(spark, d):
    df, stored = _summaries(spark, d)
    return stages.summarise_until_agreed(df, ["commit_id"], stages.replaying({"summarise_commit": stored})).select("commit_id")


@query("cluster_answers", "SELECT cluster_id, len(llm_summary.code_examples) AS pairs, [regexp_replace(x, '([.!?])\\s+(?s:.*)$', '\\1') FOR x IN llm_summary.application_conditions[1:3]] AS conditions FROM kmeans_50_10_true_summary WHERE len(all_strategy_summaries) > 0 AND len(llm_summary.application_conditions) > 0")
def cluster_answers(spark, d):
    """Summaries, code pairs and conditions of the fixed clusters, answered five times, taken from one attempt."""
    k = table(spark, d, "kmeans_50_10_true_summary").where("size(all_strategy_summaries) > 0 AND size(llm_summary.application_conditions) > 0")
    each = k.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(5))))
    summary = F.concat(F.lit("Summary: "), F.regexp_replace(F.element_at("all_strategy_summaries", F.pmod(F.col("attempt"), F.size("all_strategy_summaries")) + 1), "\n", " "))
    listed = F.array_join(F.transform("llm_summary.application_conditions", lambda x: F.concat(F.lit("- "), x)), "\n")
    say = lambda c: each.select("cluster_id", "attempt", c.alias("content"))
    ask = stages.replaying({"summarise_cluster": say(summary), "cluster_examples": say(F.to_json("llm_summary.code_examples")), "cluster_conditions": say(listed)})
    return stages.summarise_clusters(k, "cluster_id", ask).select("cluster_id", F.size("pairs").cast("long").alias("pairs"), "conditions")


@query("verified_answers", f"""WITH {_ANSWERS}, f AS (SELECT assessment_id, attempt, arg_min(applicable, answer_id) AS a, arg_min(final_applicable, answer_id) AS v, min(answer_id) AS answer_id FROM a WHERE attempt BETWEEN 1 AND 3 AND applicable IS NOT NULL AND final_applicable IS NOT NULL GROUP BY 1, 2),
k AS (SELECT assessment_id, attempt FROM (SELECT DISTINCT assessment_id FROM f), (SELECT unnest([1, 2, 3]) AS attempt)) SELECT assessment_id, attempt::INT AS attempt, coalesce(a, false) AS applicable, coalesce(a AND v, false) AS final_applicable FROM k LEFT JOIN f USING (assessment_id, attempt)""")
def verified_answers(spark, d):
    """The stored first verdicts as answers with code, and the final ones as what the check of the code said."""
    a = answers(spark, d).where("attempt BETWEEN 1 AND 3 AND applicable IS NOT NULL AND final_applicable IS NOT NULL")
    f = a.groupBy("assessment_id", "attempt").agg(F.min_by("applicable", "answer_id").alias("a"), F.min_by("final_applicable", "answer_id").alias("v"))
    first = f.select("assessment_id", "attempt", F.concat(F.lit('```json\n{"applicable": '), F.col("a").cast("string"), F.lit(', "explanation": "x"}\n```')).alias("content"))
    # an answer holds its JSON block and its code; the code is the only block that is read as such
    code = stages.Task("strategy_applies_verified", "", lambda c: {"applicable": F.get_json_object(F.regexp_extract(c, r"(?s)\{.*\}", 0), "$.applicable").cast("boolean"), "explanation": F.lit("x"), "code": F.lit("f()")}, attempts=3)
    check = f.select("assessment_id", F.col("attempt").alias("_attempt"), F.lit(1).alias("attempt"), F.concat(F.lit('{"is_valid": '), F.col("v").cast("string"), F.lit(', "uses_strategy": true}')).alias("content"))
    out = stages.applies_verified(f.select("assessment_id").distinct(), ["assessment_id"], stages.replaying({"strategy_applies_verified": first, "verify": check}), code)
    return out.select("assessment_id", "attempt", "applicable", "final_applicable")


@query("related_summaries", _KNN + " SELECT DISTINCT d_id, 'label ' || label::VARCHAR AS explanation FROM r WHERE rank <= 20")
def related_summaries(spark, d):
    texts = embeddings(spark, d).select(F.col("vec_id").alias("d_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("diff"))
    stored = texts.select("d_id", F.lit(1).alias("attempt"), F.concat(F.lit("```\n"), "diff", F.lit("\n```")).alias("content"))
    return stages.related_summaries(knn(spark, d), texts, stages.replaying({"explain": stored}))


@query("optimised_with_examples")
def optimised_with_examples(spark, d):
    e = embeddings(spark, d)
    texts = e.select(F.col("vec_id").alias("d_id"), F.lit("before").alias("before"), F.lit("diff").alias("diff"), F.col("label").cast("string").alias("summary"))
    return stages.optimise_with_examples(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.lit("f").alias("code")), knn(spark, d), texts, "summary_and_diff", stages.calling())
