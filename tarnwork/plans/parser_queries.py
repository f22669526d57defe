"""Queries over text parsers, filters and projections, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.functions import vectors
from tarnwork.operators import clusters, codefn, completions, funnel, perf, projections, setjoin, topk, votes, windows
from tarnwork.plans.analysis_queries import _ANSWERS, _KNN, answers, embeddings, knn
from tarnwork.plans.funnel_queries import _COMMITS, commits
from tarnwork.plans.registry import Registry
from tarnwork.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: White space of any script, as a class of the SQL engine.
_BLANK = r"[\x09-\x0d\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_DOCS = "t AS (SELECT DISTINCT doc_id, text FROM documents)"


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").distinct()


def _md5(c):
    return F.md5(c.cast("binary"))


@query("stripped_texts", f"WITH {_DOCS} SELECT doc_id, md5({_STRIP('text')}) AS digest, length({_STRIP('text')}) AS n FROM t")
def stripped_texts(spark, d):
    s = T.strip(F.col("text"))
    return _texts(spark, d).select("doc_id", _md5(s).alias("digest"), F.length(s).cast("long").alias("n"))


@query("word_tokens", f"WITH {_DOCS}, w AS (SELECT doc_id, [x FOR x IN regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{Nl}}\\p{{No}}_]+') IF len(x) BETWEEN 2 AND 15 AND NOT starts_with(x, '_')] AS x FROM t) SELECT doc_id, len(x) AS n, md5(array_to_string(x, ' ')) AS digest FROM w")
def word_tokens(spark, d):
    w = T.word_tokens(F.col("text"))
    return _texts(spark, d).select("doc_id", F.size(w).cast("long").alias("n"), _md5(F.array_join(w, " ")).alias("digest"))


@query("blank_tokens", f"WITH {_DOCS}, w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{_BLANK}+') IF x <> ''] AS x FROM t) SELECT doc_id, len(x) AS n, md5(array_to_string(x, ' ')) AS digest FROM w")
def blank_tokens(spark, d):
    w = T.blank_tokens(F.col("text"))
    return _texts(spark, d).select("doc_id", F.size(w).cast("long").alias("n"), _md5(F.array_join(w, " ")).alias("digest"))


@query("decoded_texts", f"WITH {_DOCS} SELECT doc_id, md5(text) AS digest FROM t")
def decoded_texts(spark, d):
    return _texts(spark, d).select("doc_id", _md5(T.decode_bytes(F.col("text").cast("binary"))).alias("digest"))


@query("split_messages", f"WITH {_COMMITS} SELECT commit_id, CASE WHEN instr(message, ': ') > 0 THEN substr(message, 1, instr(message, ': ') - 1) ELSE message END AS head, CASE WHEN instr(message, ': ') > 0 THEN substr(message, instr(message, ': ') + 2) END AS tail FROM c")
def split_messages(spark, d):
    k = T.split_key(F.col("message"), ": ")
    return commits(spark, d).select("commit_id", k["head"].alias("head"), k["tail"].alias("tail"))


@query("unfenced_texts", f"WITH {_DOCS} SELECT doc_id, md5(regexp_replace(text, '```[a-zA-Z0-9+]*\\n?', '', 'g')) AS digest FROM t")
def unfenced_texts(spark, d):
    return _texts(spark, d).select("doc_id", _md5(T.remove_fences(F.col("text"))).alias("digest"))


_SUMMARY = "s AS (SELECT DISTINCT commit_id, is_strategy_equivalent AS e, optimization_summary AS o, is_generic_optimization AS g FROM summary_commit)"


@query("equivalent_flags", f"WITH {_SUMMARY}, v AS (SELECT commit_id, unnest(e) AS e, unnest(generate_series(1, len(e))) AS k FROM s) SELECT commit_id, k::INT AS k, CASE lower(e) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag FROM v")
def equivalent_flags(spark, d):
    s = table(spark, d, "summary_commit").select("commit_id", "is_strategy_equivalent").distinct().select("commit_id", F.posexplode("is_strategy_equivalent").alias("k", "e"))
    return s.select("commit_id", (F.col("k") + 1).alias("k"), T.equivalent_flag(F.concat(F.lit("Judged with care.\nEQUIVALENT:  "), F.coalesce("e", F.lit("?")), F.lit("\n"))).alias("flag"))


@query("summary_labels", rf"WITH {_SUMMARY}, v AS (SELECT commit_id, unnest(o) AS o, unnest(generate_series(1, len(o))) AS k FROM s) SELECT commit_id, k::INT AS k, {_STRIP(f'''regexp_extract(regexp_replace(o, '^[ \t]+', ''), '^[^\n]*')''')} AS summary, 'true' AS generic FROM v WHERE o IS NOT NULL")
def summary_labels(spark, d):
    s = table(spark, d, "summary_commit").select("commit_id", "optimization_summary").distinct().select("commit_id", F.posexplode("optimization_summary").alias("k", "o")).where("o IS NOT NULL")
    answer = F.concat(F.lit("Summary: an earlier line\nGENERIC: false\nsummary: "), F.col("o"), F.lit("\nGeneric: true "))
    return s.select("commit_id", (F.col("k") + 1).alias("k"), T.labelled(answer, "Summary").alias("summary"), T.labelled(answer, "Generic").alias("generic"))


_SIDES = "f AS (SELECT repository_name, hash, max(content) FILTER (kind = 'before_func') AS b, max(content) FILTER (kind = 'after_func') AS a FROM modified_file GROUP BY 1, 2)"


def _sides(spark, d):
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("content")))
    return table(spark, d, "modified_file").groupBy("repository_name", "hash").agg(side("before_func").alias("b"), side("after_func").alias("a"))


@query("before_and_after", f"WITH {_SIDES} SELECT repository_name, hash, md5({_STRIP('b')}) AS before, md5({_STRIP('a')}) AS after FROM f WHERE b IS NOT NULL AND a IS NOT NULL AND NOT contains(a || b, '```')")
def before_and_after(spark, d):
    f = _sides(spark, d).where("b IS NOT NULL AND a IS NOT NULL AND NOT contains(a || b, '```')")
    got = T.before_and_after(F.concat(F.lit("## Before the change\n```cpp\n"), "b", F.lit("\n```\nthen\n## After\n```cpp\n"), "a", F.lit("\n```\n")))
    return f.select("repository_name", "hash", _md5(got["before"]).alias("before"), _md5(got["after"]).alias("after"))


@query("json_answers", f"WITH {_ANSWERS} SELECT answer_id, final_applicable AS applicable, md5(explanation) AS explanation, true AS parsed FROM a WHERE final_applicable IS NOT NULL AND explanation IS NOT NULL")
def json_answers(spark, d):
    a = answers(spark, d).where("final_applicable IS NOT NULL AND explanation IS NOT NULL")
    got = T.json_answer(F.concat(F.lit("So:\n```json\n"), F.to_json(F.struct(F.col("final_applicable").alias("applicable"), "explanation")), F.lit("\n```\n")))
    return a.select("answer_id", got["applicable"].alias("applicable"), _md5(got["explanation"]).alias("explanation"), got["parsed"].alias("parsed"))


@query("free_answers", f"WITH {_DOCS} SELECT doc_id, contains(lower(text), 'true') AND contains(lower(text), 'applicable') AS applicable, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END) AS explanation, false AS parsed FROM t WHERE text IS NOT NULL")
def free_answers(spark, d):
    got = T.json_answer(F.col("text"))
    return _texts(spark, d).where("text IS NOT NULL").select("doc_id", got["applicable"].alias("applicable"), _md5(got["explanation"]).alias("explanation"), got["parsed"].alias("parsed"))


@query("condition_lists", r"SELECT cluster_id, [regexp_replace(x, '([.!?])\s+(?s:.*)$', '\1') FOR x IN llm_summary.application_conditions[1:3]] AS conditions FROM kmeans_50_10_true_summary WHERE len(llm_summary.application_conditions) > 0")
def condition_lists(spark, d):
    k = table(spark, d, "kmeans_50_10_true_summary").where("size(llm_summary.application_conditions) > 0")
    listed = F.array_join(F.transform("llm_summary.application_conditions", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return k.select("cluster_id", T.conditions(F.concat(F.lit("When:\n"), listed)).alias("conditions"))


@query("code_pair_lists", "SELECT cluster_id, len(llm_summary.code_examples) AS n, llm_summary.code_examples[1][1] AS before, llm_summary.code_examples[1][2] AS after FROM kmeans_50_10_true_summary")
def code_pair_lists(spark, d):
    pairs = T.code_pairs(F.to_json("llm_summary.code_examples"))
    return table(spark, d, "kmeans_50_10_true_summary").select("cluster_id", F.size(pairs).cast("long").alias("n"), F.get(F.get(pairs, F.lit(0)), F.lit(0)).alias("before"), F.get(F.get(pairs, F.lit(0)), F.lit(1)).alias("after"))


@query("similar_answers", f"WITH {_ANSWERS}, v AS (SELECT answer_id, CASE WHEN final_applicable THEN ' Similar: ' ELSE 'Not alike: ' END || explanation AS t FROM a WHERE explanation IS NOT NULL) SELECT answer_id, contains(upper(t), 'SIMILAR') AS loose, regexp_matches({_STRIP('upper(t)')}, '^SIMILAR\\b') AS strict FROM v")
def similar_answers(spark, d):
    t = F.concat(F.when(F.col("final_applicable"), F.lit(" Similar: ")).otherwise(F.lit("Not alike: ")), "explanation")
    return answers(spark, d).where("explanation IS NOT NULL").select("answer_id", T.says_similar(t).alias("loose"), T.says_similar(t, strict=True).alias("strict"))


@query("commit_times", f"WITH {_COMMITS}, p AS (SELECT commit_id, try_cast(replace(date, 'Z', '+00:00') AS TIMESTAMPTZ) AS tm FROM c) SELECT commit_id, epoch(tm)::BIGINT AS seconds, coalesce(tm < TIMESTAMPTZ '2023-06-02 16:39:14-07:00', false) AS before_change, coalesce(tm <= TIMESTAMPTZ '2022-03-21 17:30:51-07:00', false) AS in_old_format FROM p")
def commit_times(spark, d):
    at = T.parse_offset_time(F.col("date"))
    cut = lambda s: F.expr(f"timestamp'{s}'")
    return commits(spark, d).select("commit_id", F.unix_seconds(at).alias("seconds"), F.coalesce(at < cut("2023-06-02 16:39:14-07:00"), F.lit(False)).alias("before_change"), F.coalesce(at <= cut("2022-03-21 17:30:51-07:00"), F.lit(False)).alias("in_old_format"))


@query("word_counts", f"WITH {_DOCS} SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\w+|[^\\w\\s\\x0b]')) AS n FROM t")
def word_counts(spark, d):
    return _texts(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n"))


@query("request_ids", f"WITH {_COMMITS} SELECT commit_id, sha256('is_optimization' || chr(31) || commit_id::VARCHAR || chr(31) || '1') AS request_id FROM c")
def request_ids(spark, d):
    return commits(spark, d).select("commit_id", T.request_id(F.lit("is_optimization"), F.col("commit_id").cast("string"), F.lit("1")).alias("request_id"))


@query("fewshot_texts", _KNN + ", p AS (SELECT q_id, d_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score, d_id) AS place FROM r WHERE rank <= 4) SELECT q_id, string_agg('Example ' || place::VARCHAR || ' (similarity ' || format('{:.1f}', score) || ')' || chr(10) || 'vector ' || d_id::VARCHAR, chr(10) || chr(10) ORDER BY place) AS examples FROM p GROUP BY 1")
def fewshot_texts(spark, d):
    found = topk.fewshot_order(knn(spark, d)).withColumn("text", F.concat(F.lit("vector "), F.col("d_id").cast("string")))
    return completions.fewshot_text(found, "q_id", "place", "text", "score")


@query("pretty_props", "SELECT event_id, replace(props, ' ', '') AS compact, 3 AS lines FROM events")
def pretty_props(spark, d):
    p = T.pretty_json(F.col("props"), "k long")
    return table(spark, d, "events").select("event_id", F.regexp_replace(p, r"\s+", "").alias("compact"), F.size(F.split(p, "\n")).alias("lines"))


@query("cluster_names", "SELECT vec_id, CASE WHEN label = 0 THEN 'noise' ELSE label::VARCHAR END AS name FROM (SELECT DISTINCT vec_id, label FROM embeddings)")
def cluster_names(spark, d):
    return embeddings(spark, d).select("vec_id", T.cluster_name(F.col("label") - 1).alias("name"))


@query("noise_share", "SELECT count(DISTINCT label) FILTER (label <> 0) AS clusters, count(*) FILTER (label = 0) AS noise, round(avg((label = 0)::INT), 6) AS share FROM embeddings")
def noise_share(spark, d):
    return clusters.noise_share(embeddings(spark, d).withColumn("label", F.col("label") - 1), "label")


@query("sizes_in_gb", "SELECT part.p_partkey, p_size / 1048576.0 AS gb FROM part")
def sizes_in_gb(spark, d):
    return table(spark, d, "part").select("p_partkey", T.kb_to_gb(F.col("p_size")).alias("gb"))


@query("cosines", "WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT label, arg_min(e, vec_id) AS g FROM u GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(e, g), 6) AS score FROM u JOIN f USING (label)")
def cosines(spark, d):
    e = embeddings(spark, d)
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("first")), 6).alias("score"))


@query("fused_vectors", "SELECT vec_id, len(embedding) * 2 AS n, round(list_sum(embedding::DOUBLE[]) * 2, 6) AS total FROM embeddings")
def fused_vectors(spark, d):
    v = vectors.fuse(F.col("embedding"), F.col("embedding"))
    return embeddings(spark, d).select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# ---- filters and projections


@query("commit_predicates", f"""WITH {_COMMITS} SELECT commit_id, coalesce(contains_optimization_keyword, false) AS strictly_true, coalesce({_STRIP('message')} <> '', false) AS has_message,
coalesce(modified_files_count, 0) <= 3 AS small, NOT coalesce(repository_name IN ('foltwick-db', 'drompool-core'), false) AS not_excluded, coalesce(regexp_matches(modified_files[1], '\\.(c|cpp|cc|h|hpp)$'), false) AS c_suffix, coalesce(lower(is_opt_ds_simple) = 'true', false) AS is_true FROM c""")
def commit_predicates(spark, d):
    return commits(spark, d).select(
        "commit_id", funnel.strictly_true("contains_optimization_keyword").alias("strictly_true"), funnel.has_text("message").alias("has_message"), funnel.small_enough("modified_files_count", 3).alias("small"),
        funnel.not_excluded("repository_name", ["foltwick-db", "drompool-core"]).alias("not_excluded"), F.coalesce(F.get("modified_files", F.lit(0)).rlike(T.C_SUFFIX), F.lit(False)).alias("c_suffix"), T.is_true(F.col("is_opt_ds_simple")).alias("is_true"),
    )


@query("well_formed_commits", f"WITH {_COMMITS} SELECT commit_id FROM c WHERE repository_name IS NOT NULL AND github_commit_url IS NOT NULL AND author IS NOT NULL")
def well_formed_commits(spark, d):
    return funnel.well_formed(commits(spark, d), ["repository_name", "github_commit_url", "author"]).select("commit_id")


@query("commits_with_both", f"WITH {_COMMITS}, {_SIDES} SELECT commit_id FROM c JOIN f USING (repository_name, hash) WHERE f.a IS NOT NULL AND f.b IS NOT NULL")
def commits_with_both(spark, d):
    return funnel.with_both(commits(spark, d), table(spark, d, "modified_file"), ["repository_name", "hash"], ["before_func", "after_func"]).select("commit_id")


@query("wrapped_summaries", "SELECT DISTINCT commit_id, CASE WHEN optimization_summary_final IS NULL THEN [] ELSE [optimization_summary_final] END AS optimization_summary_final FROM summary_commit")
def wrapped_summaries(spark, d):
    s = projections.wrap_scalars(table(spark, d, "summary_commit"), ["optimization_summary_final"], drop=["optimization_summary", "no_such_column"])
    return projections.drop_present(s, ["repository_name", "hash", "message", "is_generic_optimization", "is_strategy_equivalent", "is_generic_optimization_final", "is_strategy_equivalent_final"]).distinct()


@query("cluster_defaults", "SELECT cluster_id, coalesce(size, 0) AS size, coalesce(llm_summary.strategy_summary, '') AS strategy, coalesce(consistency_best_similarity, 0.0) AS similarity FROM kmeans_50_10_true_summary")
def cluster_defaults(spark, d):
    return projections.with_defaults(
        table(spark, d, "kmeans_50_10_true_summary"),
        {"cluster_id": ("cluster_id", F.lit("")), "size": ("size", F.lit(0)), "strategy": ("llm_summary.strategy_summary", F.lit("")), "similarity": ("consistency_best_similarity", F.lit(0.0))},
    )


# ---- joins and aggregations


@query("dedup_rate_total", f"WITH {_COMMITS} SELECT count(*) AS original, count(DISTINCT (hash, message)) AS kept, round(100.0 * (count(*) - count(DISTINCT (hash, message))) / count(*), 6) AS removed_pct FROM c")
def dedup_rate_total(spark, d):
    c = commits(spark, d)
    return setjoin.dedup_rate_total(setjoin.dedup_rates(c, windows.first_per_key(c, ["hash", "message"], [F.asc_nulls_first("repository_name"), "commit_id"]), "repository_name"))


_FINAL = ["optimization_summary_final", "is_generic_optimization_final"]


@query("common_in_versions", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY commit_id) AS n FROM (SELECT DISTINCT commit_id, repository_name, hash, len(optimization_summary) AS k, optimization_summary_final AS o, is_generic_optimization_final AS g, is_strategy_equivalent_final AS e FROM summary_commit) WHERE hash IS NOT NULL),
a AS (SELECT * FROM s WHERE n = 1) SELECT a.hash, a.repository_name, a.o AS v11_optimization_summary_final, a.g AS v11_is_generic_optimization_final, a.o AS v21_optimization_summary_final, a.g AS v21_is_generic_optimization_final,
a.o AS v12_optimization_summary_final, a.g AS v12_is_generic_optimization_final, a.e AS v12_is_strategy_equivalent_final, a.o AS v22_optimization_summary_final, a.g AS v22_is_generic_optimization_final, a.e AS v22_is_strategy_equivalent_final
FROM a WHERE a.o IS NOT NULL AND a.g AND a.e = 'true'""")
def common_in_versions(spark, d):
    """Four versions of the summaries: all, those with a final summary, the generic, the equivalent ones; the keys that all have."""
    s = windows.first_per_key(table(spark, d, "summary_commit").where("hash IS NOT NULL"), ["hash"], ["commit_id"])
    e = "is_strategy_equivalent_final"
    versions = {"v11": (s, _FINAL), "v21": (s.where(funnel.has_text("optimization_summary_final")), _FINAL), "v12": (s.where(funnel.strictly_true("is_generic_optimization_final")), [*_FINAL, e]), "v22": (s.where(f"{e} = 'true'"), [*_FINAL, e])}
    return setjoin.join_versions(versions, "hash", ["commit_id"], ["repository_name"])


@query("semi_with_nothing", "SELECT commit_id FROM all_commit WHERE false")
def semi_with_nothing(spark, d):
    return setjoin.keep_known(table(spark, d, "all_commit"), table(spark, d, "summary_commit").where("commit_id < 0"), ["commit_id"]).select("commit_id")


_CHAIN = f"{_COMMITS}, p AS (SELECT *, lag(hash) OVER (PARTITION BY repository_name ORDER BY commit_id) AS parent FROM c WHERE repository_name IS NOT NULL)"


@query("parents_of_commits", f"WITH {_CHAIN} SELECT p.commit_id, q.author AS parent_author, q.date AS parent_date FROM p LEFT JOIN p q ON p.repository_name = q.repository_name AND p.parent = q.hash")
def parents_of_commits(spark, d):
    """The commit before in the repository taken as the parent, found again by its hash."""
    w = windows.Window.partitionBy("repository_name").orderBy("commit_id")
    c = commits(spark, d).where("repository_name IS NOT NULL").withColumn("parent", F.lag("hash").over(w))
    return setjoin.own_row(c, ["repository_name", "hash"], ["repository_name", "parent"], ["author", "date"]).select("commit_id", "parent_author", "parent_date")


@query("assessed_commits", f"WITH {_COMMITS} SELECT DISTINCT a.assessment_id, c.commit_id FROM assessment a JOIN c ON a.repository = c.repository_name AND a.commit_hash = c.hash")
def assessed_commits(spark, d):
    a = table(spark, d, "assessment").select("assessment_id", F.col("repository").alias("repository_name"), F.col("commit_hash").alias("hash")).distinct()
    return a.join(commits(spark, d).select("repository_name", "hash", "commit_id"), ["repository_name", "hash"]).select("assessment_id", "commit_id")


@query("lists_by_label", "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS place, vec_id FROM (SELECT DISTINCT vec_id, label FROM embeddings)")
def lists_by_label(spark, d):
    return setjoin.lists_by_label(embeddings(spark, d), "label", "vec_id")


@query("best_rate", f"WITH {_ANSWERS}, b AS (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY CASE WHEN coalesce(final_applicable, false) AND error IS NULL THEN 0 WHEN error IS NULL THEN 1 ELSE 2 END, answer_id) AS o FROM a) SELECT count(*) FILTER (coalesce(final_applicable, false) AND error IS NULL) AS best_similar, count(*) FILTER (error IS NULL) AS best_valid, round(count(*) FILTER (coalesce(final_applicable, false) AND error IS NULL) / count(*) FILTER (error IS NULL), 6) AS best_rate FROM b WHERE o = 1")
def best_rate(spark, d):
    return votes.best_rate(answers(spark, d), ["assessment_id"], "answer_id", F.col("final_applicable"), F.col("error").isNotNull())


@query("status_counts", f"WITH {_ANSWERS}, s AS (SELECT CASE WHEN explanation IS NULL THEN 'error' ELSE 'success' END AS status FROM (SELECT assessment_id, k AS attempt FROM (SELECT DISTINCT assessment_id FROM a), (SELECT unnest([1, 2, 3, 4, 5]) AS k)) LEFT JOIN (SELECT assessment_id, attempt, min(explanation) AS explanation FROM a GROUP BY 1, 2) USING (assessment_id, attempt)) SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1")
def status_counts(spark, d):
    a = answers(spark, d)
    stored = a.groupBy("assessment_id", "attempt").agg(F.min("explanation").alias("content"))
    return completions.status_counts(completions.replay(a.select("assessment_id").distinct(), stored, ["assessment_id"], completions.TASKS["strategy_applies"]))


@query("quota_with_extra", """WITH c AS (SELECT DISTINCT commit_id, repository_name FROM all_commit), m AS (SELECT min(repository_name) AS r FROM c), x AS (SELECT * FROM c WHERE commit_id % 97 = 0), k AS (SELECT * FROM c WHERE commit_id % 97 <> 0),
a AS (SELECT commit_id FROM k, m WHERE repository_name = r ORDER BY commit_id LIMIT (SELECT greatest(0, least(50 - (SELECT count(*) FROM x, m WHERE repository_name = r), 400 - (SELECT count(*) FROM x))))),
b AS (SELECT commit_id FROM k, m WHERE repository_name <> r OR repository_name IS NULL ORDER BY md5(commit_id::VARCHAR), commit_id LIMIT (SELECT greatest(0, 400 - (SELECT count(*) FROM x) - (SELECT count(*) FROM a))))
SELECT commit_id FROM x UNION ALL SELECT commit_id FROM a UNION ALL SELECT commit_id FROM b""")
def quota_with_extra(spark, d):
    c = table(spark, d, "all_commit").select("commit_id", "repository_name").distinct()
    first = c.agg(F.min("repository_name")).first()[0]
    return windows.quota_sample(c, F.col("repository_name") == first, 50, 400, ["commit_id"], [F.md5(F.col("commit_id").cast("string")), "commit_id"], c.where("commit_id % 97 = 0"), ["commit_id"]).select("commit_id")


_THREE = """l AS (SELECT l_suppkey AS hash, (l_orderkey % 3)::INT AS side, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'N' END AS bench, unnest(['micros_per_op', 'seconds', 'ops_per_sec', 'MB_per_sec']) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem WHERE l_returnflag IN ('A', 'N')),
g AS (SELECT hash, side, bench, metric, avg(value) AS value FROM l GROUP BY ALL),
q AS (SELECT f.hash, f.side AS s, o.side AS t, f.bench, CASE WHEN f.metric IN ('micros_per_op', 'seconds') THEN sign(f.value - o.value) ELSE sign(o.value - f.value) END AS d FROM g f JOIN g o ON f.hash = o.hash AND f.bench = o.bench AND f.metric = o.metric AND f.side < o.side),
v AS (SELECT hash, s, t, bench, sign(count(*) FILTER (d > 0) - count(*) FILTER (d < 0)) AS w FROM q GROUP BY ALL),
k AS (SELECT hash, s, t, max(w) FILTER (bench = 'A') AS a, max(w) FILTER (bench = 'N') AS n FROM v GROUP BY ALL),
c AS (SELECT hash, s, t, CASE WHEN a = 1 AND n = 1 THEN 'both_better' WHEN a = -1 AND n = -1 THEN 'both_worse' WHEN a * n = -1 THEN 'one_better_one_worse' ELSE 'uncategorised' END AS category FROM k)"""


def _three_sides(spark, d):
    metric = lambda m, c: F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
    entries = F.array(metric("micros_per_op", "l_quantity"), metric("seconds", "l_extendedprice"), metric("ops_per_sec", "l_discount"), metric("MB_per_sec", "l_tax"))
    runs = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'N')").select(F.col("l_suppkey").alias("hash"), (F.col("l_orderkey") % 3).cast("int").cast("string").alias("side"), F.when(F.col("l_returnflag") == "A", "A").otherwise("N").alias("bench"), F.inline(entries))
    return projections.comparison_rows(perf.averages(runs, ["hash", "side"]), "hash", "side", ("A", "N"), "0", "1", "2")


@query("comparison_rows", f"WITH {_THREE}, h AS (SELECT hash, count(*) FILTER (side = 2) > 0 AS can_run, count(*) FILTER (side = 0) AS n FROM g GROUP BY 1) SELECT hash, can_run, x.category AS parent_to_child, y.category AS parent_to_other, z.category AS child_to_other, CASE WHEN can_run THEN x.category END AS parent_to_child_with_other, n AS parent_metrics FROM h LEFT JOIN (FROM c WHERE s = 0 AND t = 1) x USING (hash) LEFT JOIN (FROM c WHERE s = 0 AND t = 2) y USING (hash) LEFT JOIN (FROM c WHERE s = 1 AND t = 2) z USING (hash)")
def comparison_rows(spark, d):
    return _three_sides(spark, d).withColumn("parent_metrics", F.size("average_parent").cast("long")).drop("average_parent", "average_child", "average_other")


@query("category_by_category", f"WITH {_THREE}, e AS (SELECT unnest(['both_better', 'one_better_one_worse', 'both_worse']) AS x), p AS (SELECT y.category AS parent_to_other, x.category AS parent_to_child FROM (FROM c WHERE s = 0 AND t = 2) y JOIN (FROM c WHERE s = 0 AND t = 1) x USING (hash)) SELECT a.x AS parent_to_other, b.x AS parent_to_child, (SELECT count(*) FROM p WHERE p.parent_to_other = a.x AND p.parent_to_child = b.x) AS n FROM e a, e b")
def category_by_category(spark, d):
    return perf.cross_table(_three_sides(spark, d), "parent_to_other", "parent_to_child")


# ---- code


@query("spliced_functions", f"WITH {_SIDES}, l AS (SELECT repository_name, hash, string_split(b, chr(10)) AS x FROM f WHERE b IS NOT NULL) SELECT repository_name, hash, md5(array_to_string(list_concat(list_concat(x[1:1], ['/* body */']), x[4:]), chr(10))) AS digest FROM l")
def spliced_functions(spark, d):
    return _sides(spark, d).where("b IS NOT NULL").select("repository_name", "hash", _md5(codefn.splice(F.col("b"), F.lit(2), F.lit(3), F.lit("/* body */"))).alias("digest"))


@query("with_include", f"WITH {_SIDES} SELECT repository_name, hash, md5(CASE WHEN contains(b, '#include <cstdint>') THEN b ELSE '#include <cstdint>' || chr(10) || b END) AS digest FROM f WHERE b IS NOT NULL AND NOT contains(b, '#pragma once')")
def with_include(spark, d):
    return _sides(spark, d).where("b IS NOT NULL AND NOT contains(b, '#pragma once')").select("repository_name", "hash", _md5(codefn.add_include(F.col("b"), "<cstdint>")).alias("digest"))


def _changed_files(spark, d):
    m = table(spark, d, "modified_file").where("kind IN ('before_func', 'after_func')")
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("content")))
    return m.groupBy("repository_name", "hash", "file_path").agg(side("before_func").alias("before"), side("after_func").alias("after"))


@query("commit_rows")
def commit_rows(spark, d):
    return codefn.commit_rows(_changed_files(spark, d), ["repository_name", "hash"], "file_path", "before", "after")


@query("commit_row_keys", "SELECT DISTINCT repository_name, hash FROM modified_file WHERE kind IN ('before_func', 'after_func')")
def commit_row_keys(spark, d):
    return commit_rows(spark, d).select("repository_name", "hash")


@query("function_changes")
def function_changes(spark, d):
    return codefn.function_changes(codefn.attribute_changes(_changed_files(spark, d), ["repository_name", "hash", "file_path"], "before", "after"), ["repository_name", "hash", "file_path"])
