"""Queries over votes, clusters, coverage, performance runs, search and text parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.operators import clusters, codefn, completions, perf, topk, votes, windows
from tarnwork.plans.registry import Registry
from tarnwork.sources.tables import table
from tarnwork.staging import delete_path, fresh_path
from tarnwork.streaming.incremental import stream_upsert

query = Registry()
QUERIES, SQL = query.queries, query.sql


def answers(spark, d):
    """One row per answer of a rater."""
    return windows.first_per_key(table(spark, d, "individual_assessments"), ["answer_id"], ["attempt"])


_ANSWERS = "a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY attempt) AS rn FROM individual_assessments) WHERE rn = 1)"


def embeddings(spark, d):
    return table(spark, d, "embeddings").dropDuplicates(["vec_id"])


# ---- votes

_VOTES = f"""WITH {_ANSWERS}, v AS (SELECT assessment_id, final_applicable AS vote, count(*) AS votes, min(answer_id) AS seen, arg_min(explanation, answer_id) AS why FROM a WHERE final_applicable IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY votes DESC, seen) AS rn, sum(votes) OVER (PARTITION BY assessment_id) AS n FROM v)"""


@query("majority_vote", _VOTES + " SELECT assessment_id, vote AS winner, votes, n::BIGINT AS n, round(votes / n, 6) AS confidence, md5(why) AS why FROM r WHERE rn = 1")
def majority_vote(spark, d):
    out = votes.majority_vote(answers(spark, d), ["assessment_id"], "final_applicable", "answer_id", "explanation")
    return out.withColumn("why", F.md5(F.col("explanation").cast("binary"))).drop("explanation")


@query("strict_majority", f"WITH {_ANSWERS} SELECT assessment_id, count(*) FILTER (final_applicable) * 2 > count(*) AS passed FROM a WHERE final_applicable IS NOT NULL GROUP BY 1")
def strict_majority(spark, d):
    return votes.strict_majority(answers(spark, d), ["assessment_id"], "final_applicable")


@query("vote_with_na", """WITH s AS (SELECT DISTINCT commit_id, is_strategy_equivalent AS e, is_generic_optimization_final AS g FROM summary_commit),
v AS (SELECT commit_id, unnest(e) AS vote, unnest(generate_series(1, len(e))) AS k FROM s),
t AS (SELECT commit_id, count(*) FILTER (vote = 'true') AS t, count(*) FILTER (vote = 'false') AS f, min(k) FILTER (vote = 'true') AS ft, min(k) FILTER (vote = 'false') AS ff FROM v GROUP BY 1)
SELECT s.commit_id, CASE WHEN NOT coalesce(s.g, false) THEN 'NA' WHEN t.t > t.f OR (t.t = t.f AND t.t > 0 AND t.ft < t.ff) THEN 'true' ELSE 'false' END AS winner FROM s JOIN t USING (commit_id)""")
def vote_with_na(spark, d):
    s = table(spark, d, "summary_commit").select("commit_id", "is_strategy_equivalent", F.col("is_generic_optimization_final").alias("g")).distinct()
    return votes.vote_with_na(s.select("commit_id", "g", F.posexplode("is_strategy_equivalent").alias("k", "vote")), ["commit_id"], "vote", "k", F.col("g"))


@query("stale_votes", _VOTES + " SELECT a.assessment_id, a.voting_result AS stored, r.vote AS counted FROM (SELECT DISTINCT assessment_id, voting_result FROM assessment) a JOIN r ON a.assessment_id = r.assessment_id AND rn = 1 WHERE a.voting_result IS DISTINCT FROM r.vote")
def stale_votes(spark, d):
    won = votes.majority_vote(answers(spark, d), ["assessment_id"], "final_applicable", "answer_id").select("assessment_id", F.col("winner").alias("counted"))
    stored = table(spark, d, "assessment").select("assessment_id", F.col("voting_result").alias("stored")).distinct()
    return stored.join(won, "assessment_id").where(~F.col("stored").eqNullSafe(F.col("counted"))).select("assessment_id", "stored", "counted")


_UNITS = "u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_CENTRAL = f"""WITH {_UNITS}, p AS (SELECT x.vec_id, x.label, list_cosine_similarity(x.e, y.e) AS c FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id),
s AS (SELECT vec_id, label, avg(c) AS score FROM p GROUP BY 1, 2)"""


@query("authority_score", _CENTRAL + " SELECT vec_id, label, round(score, 6) AS score FROM s")
def authority_score(spark, d):
    return votes.centrality(embeddings(spark, d), "label", "vec_id", "embedding").select("vec_id", "label", F.round("score", 6).alias("score"))


@query("medoid", _CENTRAL + " SELECT label, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS rn FROM s) WHERE rn = 1")
def medoid(spark, d):
    return votes.medoid(embeddings(spark, d), "label", "vec_id", "embedding").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("authority_rank", _CENTRAL + " SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s")
def authority_rank(spark, d):
    s = votes.centrality(embeddings(spark, d), "label", "vec_id", "embedding").withColumn("score", F.round("score", 9))
    return windows.rank_in_group(s, ["label"], [F.desc("score"), "vec_id"]).select("vec_id", "label", "rank")


@query("budgeted_pick", """WITH p AS (SELECT DISTINCT source, doc_id, n_chars FROM documents), q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM p),
e AS (SELECT *, (coalesce(n_chars, 0) <= 700 OR pos = n)::INT AS fit FROM q), r AS (SELECT *, sum(fit) OVER (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING) AS picked FROM e)
SELECT source, doc_id, picked::BIGINT AS picked, coalesce(n_chars, 0) > 700 AS truncated FROM r WHERE fit = 1 AND picked <= 10""")
def budgeted_pick(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars").distinct()
    return windows.budgeted_pick(docs, "source", ["doc_id"], "n_chars", 10, 700).select("source", "doc_id", "picked", "truncated")


# ---- clusters and coverage


@query("cluster_profile", f"WITH {_ANSWERS} SELECT cluster_id, count(*) AS size, count(*) FILTER (final_applicable) AS generic_true, count(*) FILTER (NOT final_applicable) AS generic_false, round(count(*) FILTER (final_applicable) / greatest(count(*) FILTER (final_applicable IS NOT NULL), 1), 6) AS generic_ratio, count(DISTINCT repository_name) AS repositories FROM a GROUP BY 1")
def cluster_profile(spark, d):
    out = votes.cluster_profile(answers(spark, d), "cluster_id", "repository_name", F.col("final_applicable"))
    return out.withColumn("repositories", F.size("repositories").cast("long"))


@query("cluster_repositories", f"WITH {_ANSWERS} SELECT cluster_id, repository_name, count(*) AS n FROM a WHERE repository_name IS NOT NULL GROUP BY 1, 2")
def cluster_repositories(spark, d):
    out = votes.cluster_profile(answers(spark, d), "cluster_id", "repository_name", F.col("final_applicable"))
    return out.select("cluster_id", F.explode("repositories").alias("repository_name", "n"))


@query("cluster_survival", f"WITH {_ANSWERS}, s AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY 1) SELECT DISTINCT n, (SELECT count(*) FROM s t WHERE t.n >= s.n) AS clusters FROM s")
def cluster_survival(spark, d):
    return windows.survival_curve(answers(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("large_clusters", "SELECT cluster_id, size, llm_summary.strategy_summary AS strategy, len(llm_summary.code_examples) AS examples FROM kmeans_50_10_true_summary WHERE size >= 16 ORDER BY size DESC, cluster_id")
def large_clusters(spark, d):
    k = table(spark, d, "kmeans_50_10_true_summary").where("size >= 16")
    return k.select("cluster_id", "size", F.col("llm_summary.strategy_summary").alias("strategy"), F.size("llm_summary.code_examples").cast("long").alias("examples")).orderBy(F.desc("size"), "cluster_id")


@query("truncation_totals", "SELECT sum(used_commits_count)::BIGINT AS used, sum(truncated_diff_count)::BIGINT AS truncated, round(100.0 * sum(truncated_diff_count) / sum(used_commits_count), 6) AS pct FROM kmeans_50_10_true_summary")
def truncation_totals(spark, d):
    k = table(spark, d, "kmeans_50_10_true_summary").agg(F.sum("used_commits_count").alias("used"), F.sum("truncated_diff_count").alias("truncated"))
    return k.withColumn("pct", F.round(100.0 * F.col("truncated") / F.col("used"), 6))


def _coverage(spark, d):
    a = table(spark, d, "assessment")
    pairs = a.select("cluster_id", F.col("commit_hash").alias("commit"), F.coalesce("voting_result", F.lit(False)).alias("applicable"))
    members = a.select("cluster_id", F.col("commit_hash").alias("commit")).where("voting_confidence >= 0.7").distinct()
    return pairs, members


_COVER = """p AS (SELECT DISTINCT cluster_id, commit_hash AS k FROM assessment WHERE voting_result), m AS (SELECT DISTINCT cluster_id, commit_hash AS k FROM assessment WHERE voting_confidence >= 0.7),
t AS (SELECT count(DISTINCT k) AS n FROM m)"""


@query("coverage_totals", f"WITH {_COVER} SELECT t.n AS total_commits, (SELECT count(*) FROM p JOIN m USING (cluster_id, k)) AS own_hits, (SELECT count(*) FROM p) AS total_applicable, (SELECT count(DISTINCT k) FROM p) AS any_hits, round((SELECT count(*) FROM p) / t.n, 6) AS average FROM t")
def coverage_totals(spark, d):
    return votes.coverage_totals(*_coverage(spark, d))


@query("coverage_by_cluster", f"""WITH {_COVER}, a AS (SELECT cluster_id, count(*) AS applicable FROM p GROUP BY 1), s AS (SELECT cluster_id, count(*) AS members FROM m GROUP BY 1), o AS (SELECT cluster_id, count(*) AS own FROM p JOIN m USING (cluster_id, k) GROUP BY 1)
SELECT cluster_id, coalesce(applicable, 0) AS applicable, round(coalesce(applicable, 0) / (SELECT n FROM t), 6) AS applicable_ratio, coalesce(members, 0) AS members, coalesce(own, 0) AS own, coalesce(applicable, 0) - coalesce(own, 0) AS other FROM s FULL JOIN a USING (cluster_id) LEFT JOIN o USING (cluster_id)""")
def coverage_by_cluster(spark, d):
    return votes.coverage_by_cluster(*_coverage(spark, d))


@query("coverage_histogram", f"""WITH {_COVER}, c AS (SELECT k, count(p.cluster_id) AS n FROM (SELECT DISTINCT k FROM m) LEFT JOIN p USING (k) GROUP BY 1)
SELECT g AS n_strategies, (SELECT count(*) FROM c WHERE n = g) AS commits FROM (SELECT unnest(generate_series(0, (SELECT max(n) FROM c))) AS g)""")
def coverage_histogram(spark, d):
    return votes.coverage_histogram(*_coverage(spark, d))


@query("best_attempt", f"WITH {_ANSWERS} SELECT assessment_id, answer_id FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY CASE WHEN coalesce(final_applicable, false) AND error IS NULL THEN 0 WHEN error IS NULL THEN 1 ELSE 2 END, answer_id) AS o FROM a) WHERE o = 1")
def best_attempt(spark, d):
    return votes.best_attempt(answers(spark, d), ["assessment_id"], "answer_id", F.col("final_applicable"), F.col("error").isNotNull()).select("assessment_id", "answer_id")


@query("attempt_rates", f"WITH {_ANSWERS} SELECT count(*) FILTER (coalesce(final_applicable, false) AND error IS NULL) AS similar, count(*) FILTER (NOT coalesce(final_applicable, false) AND error IS NULL) AS different, count(*) FILTER (error IS NOT NULL) AS errors, round(count(*) FILTER (coalesce(final_applicable, false) AND error IS NULL) / count(*) FILTER (error IS NULL), 6) AS rate FROM a")
def attempt_rates(spark, d):
    return votes.attempt_rates(answers(spark, d), F.col("final_applicable"), F.col("error").isNotNull())


@query("cluster_references", """WITH m AS (SELECT DISTINCT cluster_id, assessment_id AS k FROM assessment WHERE voting_result), p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(k::VARCHAR), k) AS r FROM m)
SELECT cluster_id, k, reference, n FROM (SELECT m.cluster_id, m.k, p.k AS reference, row_number() OVER (PARTITION BY m.cluster_id, m.k ORDER BY p.r) AS n FROM m JOIN p ON m.cluster_id = p.cluster_id AND m.k <> p.k) WHERE n <= 3""")
def cluster_references(spark, d):
    m = table(spark, d, "assessment").where("voting_result").select("cluster_id", F.col("assessment_id").alias("k"))
    return windows.references_for(m, "cluster_id", "k", 3)


# ---- performance runs: a supplier stands for a commit, a line status for a side, a return flag for a benchmark

_LONG = """l AS (SELECT l_suppkey AS hash, l_linestatus AS side, l_returnflag AS bench, l_linenumber AS run, unnest(['micros_per_op', 'seconds', 'ops_per_sec', 'MB_per_sec']) AS metric,
unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem WHERE l_returnflag IN ('A', 'N')),
g AS (SELECT hash, side, bench, metric, avg(value) AS value FROM l GROUP BY ALL)"""
_BOTH = _LONG + """, b AS (SELECT f.hash, f.bench, f.metric, f.value AS base, o.value AS other FROM g f JOIN g o ON f.hash = o.hash AND f.bench = o.bench AND f.metric = o.metric WHERE f.side = 'F' AND o.side = 'O'),
q AS (SELECT *, CASE WHEN metric IN ('micros_per_op', 'seconds') THEN CASE WHEN other < base THEN 'better' WHEN other > base THEN 'worse' ELSE 'no change' END ELSE CASE WHEN other > base THEN 'better' WHEN other < base THEN 'worse' ELSE 'no change' END END AS d FROM b),
v AS (SELECT hash, bench, count(*) FILTER (d = 'better') AS better, count(*) FILTER (d = 'worse') AS worse FROM q GROUP BY ALL),
w AS (SELECT *, CASE WHEN better > worse THEN 'better' WHEN worse > better THEN 'worse' ELSE 'no change' END AS verdict FROM v),
k AS (SELECT hash, max(CASE WHEN bench = 'A' THEN verdict END) AS v0, max(CASE WHEN bench = 'N' THEN verdict END) AS v1 FROM w GROUP BY 1),
c AS (SELECT hash, CASE WHEN v0 = 'better' AND v1 = 'better' THEN 'both_better' WHEN v0 = 'worse' AND v1 = 'worse' THEN 'both_worse' WHEN (v0 = 'better' AND v1 = 'worse') OR (v0 = 'worse' AND v1 = 'better') THEN 'one_better_one_worse' ELSE 'uncategorised' END AS category FROM k)"""


def runs(spark, d):
    metric = lambda m, c: F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
    entries = F.array(metric("micros_per_op", "l_quantity"), metric("seconds", "l_extendedprice"), metric("ops_per_sec", "l_discount"), metric("MB_per_sec", "l_tax"))
    return table(spark, d, "lineitem").where("l_returnflag IN ('A', 'N')").select(F.col("l_suppkey").alias("hash"), F.col("l_linestatus").alias("side"), F.col("l_returnflag").alias("bench"), F.col("l_linenumber").alias("run"), F.inline(entries))


def compared(spark, d):
    return perf.compare_sides(perf.averages(runs(spark, d), ["hash", "side"]), ["hash"], "side", "F", "O")


@query("metric_avg", f"WITH {_LONG} SELECT hash, side, bench, metric, round(value, 8) AS value FROM g")
def metric_avg(spark, d):
    return perf.averages(runs(spark, d), ["hash", "side"]).select("hash", "side", "bench", "metric", F.round("value", 8).alias("value"))


@query("metric_avg_first_keys", f"WITH {_LONG} SELECT hash, side, bench, metric, round(avg(value), 8) AS value FROM l WHERE (hash, side, bench, metric) IN (SELECT hash, side, bench, metric FROM l WHERE run = 1) GROUP BY ALL")
def metric_avg_first_keys(spark, d):
    return perf.averages(runs(spark, d), ["hash", "side"], first_run_only_keys=True).select("hash", "side", "bench", "metric", F.round("value", 8).alias("value"))


@query("pct_change", f"WITH {_BOTH} SELECT hash, bench, metric, CASE WHEN base <> 0 THEN round((other - base) / base * 100, 4) END AS pct, CASE WHEN other > base THEN 'increased' WHEN other < base THEN 'decreased' ELSE 'no change' END AS movement FROM b")
def pct_change(spark, d):
    return compared(spark, d).select("hash", "bench", "metric", F.round("pct_change", 4).alias("pct"), perf.movement(F.col("base"), F.col("other")).alias("movement"))


@query("direction", f"WITH {_BOTH} SELECT hash, bench, metric, d AS direction FROM q")
def direction(spark, d):
    return compared(spark, d).select("hash", "bench", "metric", perf.direction(F.col("metric"), F.col("base"), F.col("other")).alias("direction"))


@query("verdict", f"WITH {_BOTH} SELECT * FROM w")
def verdict(spark, d):
    return perf.verdicts(compared(spark, d), ["hash"])


@query("category_hist", f"WITH {_BOTH} SELECT category, count(*) AS n FROM c GROUP BY 1")
def category_hist(spark, d):
    return perf.category(perf.verdicts(compared(spark, d), ["hash"]), ["hash"], ("A", "N")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("category_crosstab", f"WITH {_BOTH}, e AS (SELECT unnest(['both_better', 'one_better_one_worse', 'both_worse']) AS x), t AS (SELECT hash, category AS llm, CASE WHEN hash % 2 = 0 THEN category ELSE 'both_better' END AS child FROM c) SELECT a.x AS llm, b.x AS child, (SELECT count(*) FROM t WHERE t.llm = a.x AND t.child = b.x) AS n FROM e a, e b")
def category_crosstab(spark, d):
    c = perf.category(perf.verdicts(compared(spark, d), ["hash"]), ["hash"], ("A", "N"))
    return perf.cross_table(c.select(F.col("category").alias("llm"), F.when(F.col("hash") % 2 == 0, F.col("category")).otherwise("both_better").alias("child")), "llm", "child")


@query("consistency", f"WITH {_BOTH} SELECT (SELECT count(*) FROM c) AS commits, (SELECT count(*) FROM (SELECT DISTINCT hash FROM w)) AS judged, (SELECT count(*) FROM c) = (SELECT count(*) FROM (SELECT DISTINCT hash FROM w)) AS equal")
def consistency(spark, d):
    v = perf.verdicts(compared(spark, d), ["hash"])
    a = perf.category(v, ["hash"], ("A", "N")).agg(F.count(F.lit(1)).alias("commits")).withColumn("k", F.lit(1))
    b = v.agg(F.count_distinct("hash").alias("judged")).withColumn("k", F.lit(1))
    return a.join(b, "k").select("commits", "judged", (F.col("commits") == F.col("judged")).alias("equal"))


# ---- search

_KNN = """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS q_id, d.vec_id AS d_id, round(list_cosine_similarity(q.e, d.e), 9) AS score, d.label AS label FROM u q JOIN u d ON q.label <> d.label AND q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS rank FROM s)"""


def knn(spark, d):
    e = embeddings(spark, d)
    return topk.cosine_topk(e, e.where("vec_id % 20 = 0"), id="vec_id", vector="embedding", group="label")


@query("knn_topk", _KNN + " SELECT q_id, d_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def knn_topk(spark, d):
    return knn(spark, d).select("q_id", "d_id", F.round("score", 6).alias("score"), "rank")


@query("topk_unique", _KNN + ", o AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, d_id) AS f FROM r WHERE rank <= 20) SELECT q_id, d_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS rank FROM o WHERE f = 1 QUALIFY rank <= 4".replace("o AS (SELECT *,", "o AS (SELECT q_id, d_id, score, label,"))
def topk_unique(spark, d):
    labels = embeddings(spark, d).select(F.col("vec_id").alias("d_id"), "label")
    return topk.topk_unique(knn(spark, d).join(labels, "d_id"), keys=["label"], k=4).select("q_id", "d_id", "rank")


@query("fewshot_order", _KNN + " SELECT q_id, d_id, row_number() OVER (PARTITION BY q_id ORDER BY score, d_id) AS place FROM r WHERE rank <= 4")
def fewshot_order(spark, d):
    return topk.fewshot_order(knn(spark, d)).select("q_id", "d_id", "place")


_BM25 = """WITH m AS (SELECT DISTINCT file_id, repository_name AS g, content FROM modified_file WHERE kind = 'before_func'),
d AS (SELECT file_id, g, [x FOR x IN regexp_extract_all(lower(coalesce(content, '')), '[a-z]+') IF len(x) BETWEEN 2 AND 15] AS t FROM m),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT file_id, w, count(*)::DOUBLE AS c FROM (SELECT file_id, unnest(t) AS w FROM d) GROUP BY 1, 2),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
i0 AS (SELECT w, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
i AS (SELECT w, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
qt AS (SELECT file_id AS q_id, w, count(*)::DOUBLE AS qc FROM (SELECT file_id, unnest(t) AS w FROM d WHERE file_id % 20 = 0) GROUP BY 1, 2),
sc AS (SELECT q_id, tf.file_id AS d_id, sum(qc * idf * c * 2.5 / (c + 1.5 * (1 - 0.75 + 0.75 * len(d.t) / avgdl))) AS score FROM qt JOIN tf USING (w) JOIN i USING (w) JOIN d ON d.file_id = tf.file_id, st GROUP BY 1, 2),
al AS (SELECT q.file_id AS q_id, d.file_id AS d_id, round(coalesce(sc.score, 0), 9) AS score FROM d q JOIN d ON q.file_id % 20 = 0 AND len(q.t) > 0 AND q.file_id <> d.file_id AND (q.g <> d.g OR q.g IS NULL OR d.g IS NULL) LEFT JOIN sc ON sc.q_id = q.file_id AND sc.d_id = d.file_id)
SELECT q_id, d_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS rank FROM al) WHERE rank <= 20"""


@query("bm25_topk", _BM25)
def bm25_topk(spark, d):
    m = table(spark, d, "modified_file").where("kind = 'before_func'").select("file_id", "repository_name", "content")
    out = topk.bm25_topk(m, m.where("file_id % 20 = 0"), id="file_id", text="content", group="repository_name")
    return out.select("q_id", "d_id", F.round("score", 6).alias("score"), "rank")


@query("token_counts", "SELECT doc_id, len([x FOR x IN regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') IF len(x) BETWEEN 2 AND 15]) AS n FROM (SELECT DISTINCT doc_id, text FROM documents)")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", F.size(T.ascii_tokens(F.col("text"))).cast("long").alias("n"))


# ---- text parsers


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fenced_code", r"WITH t AS (SELECT DISTINCT doc_id, text FROM documents) SELECT doc_id, len(regexp_extract_all(text, '(?s)```(?:[a-zA-Z0-9+]*\n)?(.*?)```', 1)) AS blocks, md5(regexp_replace(regexp_extract_all(text, '(?s)```(?:[a-zA-Z0-9+]*\n)?(.*?)```', 1)[1], '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS first FROM t WHERE contains(text, '```')")
def fenced_code(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").distinct().where(F.col("text").contains("```"))
    blocks = T.fenced_blocks(F.col("text"))
    return t.select("doc_id", F.size(blocks).cast("long").alias("blocks"), F.md5(F.get(blocks, F.lit(0)).cast("binary")).alias("first"))


@query("fence_unwrap", r"""WITH t AS (SELECT DISTINCT answer_id, optimized_code AS c FROM individual_assessments WHERE optimized_code IS NOT NULL), s AS (SELECT answer_id, c, string_split(regexp_replace(c, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), chr(10)) AS l FROM t)
SELECT answer_id, md5(CASE WHEN len(l) >= 2 AND starts_with(l[1], '```') AND starts_with(l[-1], '```') THEN array_to_string(l[2:len(l) - 1], chr(10)) ELSE c END) AS digest FROM s""")
def fence_unwrap(spark, d):
    t = table(spark, d, "individual_assessments").where("optimized_code IS NOT NULL").select("answer_id", "optimized_code").distinct()
    return t.select("answer_id", F.md5(T.unwrap_fence(F.col("optimized_code")).cast("binary")).alias("digest"))


@query("label_parse", r"WITH t AS (SELECT DISTINCT commit_id, coalesce(message, '') || chr(10) || 'GENERIC:  ' || coalesce(is_opt_ds_simple, 'x') || ' ' AS a, coalesce(is_opt_ds_simple, 'x') AS o FROM all_commit) SELECT commit_id, o AS generic, regexp_extract(a, '(?im)^[ \t]*summary:', 0) <> '' AS summarised FROM t")
def label_parse(spark, d):
    """The last label counts, whatever labels a message holds itself."""
    c = table(spark, d, "all_commit").select("commit_id", "message", "is_opt_ds_simple").distinct()
    a = F.concat(F.coalesce("message", F.lit("")), F.lit("\nGENERIC:  "), F.coalesce("is_opt_ds_simple", F.lit("x")), F.lit(" "))
    return c.select("commit_id", T.labelled(a, "Generic").alias("generic"), T.labelled(a, "Summary").isNotNull().alias("summarised"))


@query("tri_state", "SELECT coalesce(CASE WHEN lower(is_opt_ds_simple) IN ('true', 'false') THEN lower(is_opt_ds_simple) END, 'unknown') AS state, count(*) AS n FROM (SELECT DISTINCT commit_id, is_opt_ds_simple FROM all_commit) GROUP BY 1")
def tri_state(spark, d):
    c = table(spark, d, "all_commit").select("commit_id", "is_opt_ds_simple").distinct()
    return c.groupBy(T.tri_state(F.col("is_opt_ds_simple")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("truncated_texts", "SELECT doc_id, length(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...[truncated]' ELSE text END) AS n FROM (SELECT DISTINCT doc_id, text FROM documents)")
def truncated_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", F.length(T.truncate(F.col("text"), 500, "...[truncated]")).cast("long").alias("n"))


@query("similar_verdicts", f"WITH {_ANSWERS} SELECT answer_id, contains(upper(explanation), 'SIMILAR') AS hit FROM a WHERE explanation IS NOT NULL")
def similar_verdicts(spark, d):
    return answers(spark, d).where("explanation IS NOT NULL").select("answer_id", T.says_similar(F.col("explanation")).alias("hit"))


# ---- functions, clustering, completions, streams: no SQL; checked by tests


@query("parse_functions")
def parse_functions(spark, d):
    m = table(spark, d, "modified_file").where("kind = 'before_func'").dropDuplicates(["file_id"])
    return codefn.parse_functions(m, ["file_id"], "content")


def _pairs_of_functions(spark, d):
    m = table(spark, d, "modified_file").where("kind IN ('before_func', 'after_func')")
    return m.groupBy("repository_name", "hash", "file_path").agg(F.max(F.when(F.col("kind") == "before_func", F.col("content"))).alias("before"), F.max(F.when(F.col("kind") == "after_func", F.col("content"))).alias("after"))


@query("diff_attribution")
def diff_attribution(spark, d):
    return codefn.attribute_changes(_pairs_of_functions(spark, d), ["repository_name", "hash", "file_path"], "before", "after")


@query("modified_functions")
def modified_functions(spark, d):
    return codefn.modified_functions(diff_attribution(spark, d), ["repository_name", "hash", "file_path"])


@query("unified_diffs")
def unified_diffs(spark, d):
    return codefn.unified_diff(_pairs_of_functions(spark, d), "before", "after").select("repository_name", "hash", "file_path", F.md5(F.col("diff").cast("binary")).alias("digest"))


@query("kmeans")
def kmeans(spark, d):
    return clusters.kmeans(embeddings(spark, d), "embedding", 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("pca")
def pca(spark, d):
    return clusters.pca(embeddings(spark, d), "embedding", 8).select("vec_id", F.transform("reduced", lambda x: F.round(F.abs(x), 4)).alias("reduced"))


@query("ward")
def ward(spark, d):
    return clusters.ward(embeddings(spark, d), "vec_id", "embedding", 10).select("vec_id", "cluster")


@query("density")
def density(spark, d):
    return clusters.density(embeddings(spark, d), "vec_id", "embedding", 5, 5).select("vec_id", "cluster")


@query("choose_k")
def choose_k(spark, d):
    return clusters.choose_k(embeddings(spark, d), "vec_id", "embedding")


@query("llm_replay", f"WITH {_ANSWERS} SELECT assessment_id, count(*) AS asked, count(*) FILTER (explanation IS NULL) AS errors FROM (SELECT assessment_id, k AS attempt FROM (SELECT DISTINCT assessment_id FROM a), (SELECT unnest([1, 2, 3, 4, 5]) AS k)) LEFT JOIN (SELECT assessment_id, attempt, min(explanation) AS explanation FROM a GROUP BY 1, 2) USING (assessment_id, attempt) GROUP BY 1")
def llm_replay(spark, d):
    a = answers(spark, d)
    stored = a.groupBy("assessment_id", "attempt").agg(F.min("explanation").alias("content"))
    out = completions.replay(a.select("assessment_id").distinct(), stored, ["assessment_id"], completions.TASKS["strategy_applies"])
    return out.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("status") == "error").alias("errors"))


@query("llm_stub")
def llm_stub(spark, d):
    s = table(spark, d, "summary_commit").select("commit_id", "message", F.col("optimization_summary_final").alias("diff")).distinct()
    out = completions.run(s, ["commit_id"], completions.TASKS["summarise_commit"])
    return votes.majority_vote(out, ["commit_id"], "generic", "attempt")


@query("stream_upsert", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY 1")
def query_stream_upsert(spark, d):
    """events as a file stream merged by key into a table, run twice: the second run adds nothing."""
    base = fresh_path(spark, "stream")
    src = f"{base}/in"
    events = table(spark, d, "events")
    events.write.parquet(src)
    for _ in range(2):
        stream_upsert(spark, src, events.schema, ["event_id"], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    delete_path(spark, src)
    return out


@query("cluster_inertia", "WITH u AS (SELECT label, unnest(generate_series(1, 64)) AS i, unnest(embedding::DOUBLE[]) AS x, vec_id FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2) SELECT label, count(DISTINCT vec_id) AS size, round(sum((x - m) ** 2), 4) AS inertia FROM u JOIN m USING (label, i) GROUP BY 1")
def cluster_inertia(spark, d):
    return clusters.inertia(embeddings(spark, d), "label", "embedding").select("label", "size", F.round("inertia", 4).alias("inertia"))


@query("nested_metrics", "SELECT l_suppkey AS hash, l_returnflag AS bench, sum(l_quantity) AS value FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A') AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1, 2")
def nested_metrics(spark, d):
    """Maps of bench to metrics, kept where both benches have results, and back to long form."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("hash"), "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    nested = per.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.create_map(F.lit("quantity"), "v")))).alias("m"))
    return perf.explode_results(nested.where(perf.has_results(F.col("m"), ["A", "N"])), ["hash"], "m").select("hash", "bench", "value")


@query("change_reports")
def change_reports(spark, d):
    return codefn.change_report(diff_attribution(spark, d), ["repository_name", "hash", "file_path"])


def _stages_sql() -> str:
    from tarnwork.plans.funnel_queries import _COMMITS, _HIT, _IS_C

    return f"""WITH {_COMMITS}, s1 AS (FROM c WHERE modified_files_count = 1), s2 AS (FROM s1 WHERE {_IS_C}), s3 AS (FROM s2 WHERE {_HIT}), s4 AS (FROM s3 WHERE modified_func_count = 1 AND NOT modified_other),
s5 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY hash, message ORDER BY repository_name NULLS FIRST, commit_id) AS n FROM s4) WHERE n = 1), s6 AS (FROM s5 WHERE lower(is_opt_ds_simple) = 'true')
SELECT 'one_file' AS stage, count(*) AS n FROM s1 UNION ALL SELECT 'c_language', count(*) FROM s2 UNION ALL SELECT 'is_opt_keyword', count(*) FROM s3 UNION ALL SELECT 'one_func', count(*) FROM s4 UNION ALL SELECT 'deduplicated', count(*) FROM s5 UNION ALL SELECT 'is_opt_final', count(*) FROM s6"""


@query("funnel_pipeline", _stages_sql())
def funnel_pipeline(spark, d):
    """The funnel as a pipeline of written tables, all stages counted; a second run finds all tables made."""
    from tarnwork.plans.funnel_queries import commits
    from tarnwork.plans.pipeline import FUNNEL, run

    root = fresh_path(spark, "funnel")
    for _ in range(2):
        out = run(spark, FUNNEL, {"commits": commits(spark, d)}, root)
    counts = [out[name].agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n")) for name, _ in FUNNEL]
    for c in counts[1:]:
        counts[0] = counts[0].unionByName(c)
    return counts[0]
