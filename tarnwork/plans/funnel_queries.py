"""Queries over the commit funnel, duplicates and set joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.operators import funnel, setjoin, windows
from tarnwork.plans.registry import Registry
from tarnwork.sources.files import bytes_by_kind
from tarnwork.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_COMMITS = "c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY loaded_at) AS n FROM all_commit) WHERE n = 1)"


def commits(spark, d):
    """One row per commit: the earliest arrival."""
    return windows.first_per_key(table(spark, d, "all_commit"), ["commit_id"], ["loaded_at"])


def _in(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(message), '{w}')" for w in words)


_HIT = f"coalesce({_in(funnel.KEYWORDS)}, false)"
_EXT = "regexp_extract(modified_files[1], '[^/.][^/]*(\\.[^./]*)$', 1)"
_IS_C = f"coalesce(len(modified_files) > 0 AND lower({_EXT}) IN ('.c', '.cpp', '.cc', '.cxx', '.h', '.hpp', '.hxx'), false)"
STAGES = ["one_file", "c_language", "is_opt_keyword", "one_func", "is_opt_llm"]


def stages(spark, d):
    return funnel.cumulative_stages(
        commits(spark, d),
        [("one_file", funnel.one_file()), ("c_language", funnel.first_file_is_c()), ("is_opt_keyword", funnel.keyword_hit()), ("one_func", funnel.one_function()), ("is_opt_llm", F.lower("is_opt_ds_simple") == "true")],
    )


_STAGED = f"""{_COMMITS},
s AS (SELECT *, coalesce(modified_files_count = 1, false) AS s1, {_IS_C} AS s2, {_HIT} AS s3, coalesce(modified_func_count = 1 AND NOT modified_other, false) AS s4, coalesce(lower(is_opt_ds_simple) = 'true', false) AS s5 FROM c),
f AS (SELECT repository_name, count(*) AS all_rows, count(*) FILTER (s1) AS one_file, count(*) FILTER (s1 AND s2) AS c_language, count(*) FILTER (s1 AND s2 AND s3) AS is_opt_keyword,
             count(*) FILTER (s1 AND s2 AND s3 AND s4) AS one_func, count(*) FILTER (s1 AND s2 AND s3 AND s4 AND s5) AS is_opt_llm FROM s GROUP BY 1)"""


@query("one_file_commits", f"WITH {_COMMITS} SELECT commit_id FROM c WHERE modified_files_count = 1")
def one_file_commits(spark, d):
    return commits(spark, d).where(funnel.one_file()).select("commit_id")


@query("extension_filter", f"WITH {_COMMITS} SELECT commit_id, modified_files[1] AS first_file FROM c WHERE {_IS_C}")
def extension_filter(spark, d):
    return commits(spark, d).where(funnel.first_file_is_c()).select("commit_id", F.get("modified_files", F.lit(0)).alias("first_file"))


@query("keyword_filter", f"WITH {_COMMITS} SELECT commit_id, true AS contains_keyword FROM c WHERE {_HIT}")
def keyword_filter(spark, d):
    return commits(spark, d).where(funnel.keyword_hit()).select("commit_id", F.lit(True).alias("contains_keyword"))


@query("keyword_hits", f"WITH {_COMMITS}, k AS (SELECT unnest({funnel.KEYWORDS!r}) AS word) SELECT word, count(*) AS n FROM c JOIN k ON contains(lower(message), word) GROUP BY 1".replace('"', "'"))
def keyword_hits(spark, d):
    low = F.lower("message")
    words = F.filter(F.array(*[F.lit(w) for w in funnel.KEYWORDS]), lambda w: F.contains(low, w))
    return commits(spark, d).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("one_func_commits", f"WITH {_COMMITS} SELECT commit_id FROM c WHERE modified_func_count = 1 AND NOT modified_other")
def one_func_commits(spark, d):
    return commits(spark, d).where(funnel.one_function()).select("commit_id")


@query("labelled_true", f"WITH {_COMMITS} SELECT commit_id FROM c WHERE lower(is_opt_ds_simple) = 'true'")
def labelled_true(spark, d):
    return commits(spark, d).where(F.lower("is_opt_ds_simple") == "true").select("commit_id")


@query("unlabelled_retry", f"WITH {_COMMITS} SELECT commit_id FROM c WHERE is_opt_ds_simple IS NULL OR is_opt_ds_simple NOT IN ('true', 'false')")
def unlabelled_retry(spark, d):
    return commits(spark, d).where(T.tri_state(F.coalesce("is_opt_ds_simple", F.lit(""))) == "unknown").select("commit_id")


@query("funnel_by_repository", f"WITH {_STAGED} SELECT * FROM f")
def funnel_by_repository(spark, d):
    return funnel.funnel_counts(stages(spark, d), "repository_name", STAGES)


@query("funnel_totals", f"WITH {_STAGED} SELECT stage, sum(n)::BIGINT AS total, round(avg(n), 6) AS average, count(n) AS groups FROM (UNPIVOT (SELECT {', '.join(STAGES)} FROM f) ON {', '.join(STAGES)} INTO NAME stage VALUE n) GROUP BY 1")
def funnel_totals(spark, d):
    return funnel.funnel_totals(funnel.funnel_counts(stages(spark, d), "repository_name", STAGES), STAGES)


_BLOBS = "b AS (SELECT repository_name, hash, coalesce(bool_or(kind = 'before_func' AND content IS NOT NULL), false) AS has_before_func, coalesce(bool_or(kind = 'after_func' AND content IS NOT NULL), false) AS has_after_func, coalesce(bool_or(kind = 'diff' AND content IS NOT NULL), false) AS has_diff FROM modified_file GROUP BY 1, 2)"


@query("blob_presence", f"WITH {_BLOBS} SELECT *, concat_ws(',', CASE WHEN NOT has_before_func THEN 'before_func' END, CASE WHEN NOT has_after_func THEN 'after_func' END, CASE WHEN NOT has_diff THEN 'diff' END) AS missing FROM b")
def blob_presence(spark, d):
    return funnel.blob_presence(table(spark, d, "modified_file"), ["repository_name", "hash"], ["before_func", "after_func", "diff"])


@query("reject_log", f"WITH {_COMMITS} SELECT commit_id, concat_ws(',', CASE WHEN NOT coalesce(modified_files_count = 1, false) THEN 'one_file' END, CASE WHEN NOT {_IS_C} THEN 'c_language' END) AS reason FROM c WHERE NOT coalesce(modified_files_count = 1, false) OR NOT {_IS_C}")
def reject_log(spark, d):
    return funnel.split_rejects(commits(spark, d), [("one_file", funnel.one_file()), ("c_language", funnel.first_file_is_c())])[1].select("commit_id", "reason")


@query("text_lookup", f"WITH {_COMMITS}, m AS (SELECT repository_name, hash, min(content) AS text FROM modified_file WHERE kind = 'diff' GROUP BY 1, 2) SELECT commit_id, md5(coalesce(m.text, 'no diff')) AS digest FROM c LEFT JOIN m USING (repository_name, hash)")
def text_lookup(spark, d):
    out = funnel.lookup_text(commits(spark, d), table(spark, d, "modified_file"), ["repository_name", "hash"], "diff", "no diff")
    return out.select("commit_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("commit_urls", f"WITH {_COMMITS} SELECT commit_id, regexp_replace('https://git.example.invalid/' || repository_name || '.git', '\\.git$', '') || '/commit/' || hash AS url, repository_name || '::' || hash AS key FROM c")
def commit_urls(spark, d):
    c = commits(spark, d)
    url = T.commit_url(F.concat(F.lit("https://git.example.invalid/"), "repository_name", F.lit(".git")), F.col("hash"))
    return c.select("commit_id", url.alias("url"), F.when(F.col("repository_name").isNotNull() & F.col("hash").isNotNull(), T.composite_key(F.col("repository_name"), F.col("hash"))).alias("key"))


@query("url_parts", f"WITH {_COMMITS} SELECT commit_id, regexp_extract(github_commit_url, '^https?://[^/:]+/([^/]+)/', 1) AS repo, regexp_extract(github_commit_url, '/commit/([0-9a-f]+)$', 1) AS sha FROM c WHERE github_commit_url IS NOT NULL")
def url_parts(spark, d):
    c = commits(spark, d).where("github_commit_url IS NOT NULL")
    return c.select("commit_id", T.owner_and_repo(F.col("github_commit_url"))["owner"].alias("repo"), F.regexp_extract("github_commit_url", r"/commit/([0-9a-f]+)$", 1).alias("sha"))


_BLANK = r"[\x09-\x0d\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("stripped_messages", f"WITH {_COMMITS} SELECT commit_id, length(regexp_replace(message, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS n FROM c")
def stripped_messages(spark, d):
    return commits(spark, d).select("commit_id", F.length(T.strip(F.col("message"))).alias("n"))


@query("joined_files", f"WITH {_COMMITS} SELECT commit_id, coalesce(array_to_string(modified_files, ', '), '') AS files, coalesce(array_to_string(modified_func, ', '), '') AS funcs FROM c")
def joined_files(spark, d):
    return commits(spark, d).select("commit_id", F.coalesce(F.array_join("modified_files", ", "), F.lit("")).alias("files"), F.coalesce(F.array_join("modified_func", ", "), F.lit("")).alias("funcs"))


@query("date_cutoff", f"WITH {_COMMITS} SELECT commit_id FROM c WHERE try_cast(replace(date, 'Z', '+00:00') AS TIMESTAMPTZ) < TIMESTAMPTZ '2023-06-02 16:39:14-07:00'")
def date_cutoff(spark, d):
    return commits(spark, d).where(T.parse_offset_time(F.col("date")) < F.expr("timestamp'2023-06-02 16:39:14-07:00'")).select("commit_id")


@query("incremental_skip", f"WITH {_COMMITS} SELECT commit_id FROM c WHERE commit_id NOT IN (SELECT commit_id FROM summary_commit)")
def incremental_skip(spark, d):
    return setjoin.drop_known(commits(spark, d), table(spark, d, "summary_commit"), ["commit_id"]).select("commit_id")


@query("dedup_first", f"WITH {_COMMITS} SELECT commit_id FROM (SELECT commit_id, row_number() OVER (PARTITION BY hash, message ORDER BY repository_name NULLS FIRST, commit_id) AS n FROM c) WHERE n = 1")
def dedup_first(spark, d):
    return windows.first_per_key(commits(spark, d), ["hash", "message"], [F.asc_nulls_first("repository_name"), "commit_id"]).select("commit_id")


@query("dedup_null_keys_kept", "SELECT DISTINCT assessment_id FROM (SELECT assessment_id, repository, dense_rank() OVER (PARTITION BY repository ORDER BY assessment_id) AS n FROM assessment) WHERE n = 1 OR repository IS NULL")
def dedup_null_keys_kept(spark, d):
    a = table(spark, d, "assessment").select("assessment_id", "repository").distinct()
    return windows.first_per_key(a, ["repository"], ["assessment_id"], keep_null_keys=True).select("assessment_id")


@query("dedup_rate", f"""WITH {_COMMITS}, k AS (SELECT *, row_number() OVER (PARTITION BY hash, message ORDER BY repository_name NULLS FIRST, commit_id) AS n FROM c)
SELECT repository_name, count(*) AS original, count(*) FILTER (n = 1) AS kept, round(100.0 * (count(*) - count(*) FILTER (n = 1)) / count(*), 6) AS removed_pct FROM k GROUP BY 1""")
def dedup_rate(spark, d):
    c = commits(spark, d)
    return setjoin.dedup_rates(c, windows.first_per_key(c, ["hash", "message"], [F.asc_nulls_first("repository_name"), "commit_id"]), "repository_name")


@query("dup_report", "SELECT doc_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_report(spark, d):
    return setjoin.duplicate_keys(table(spark, d, "documents"), ["doc_id"])


@query("exact_text_groups", "SELECT md5(text) AS digest, count(DISTINCT doc_id) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def exact_text_groups(spark, d):
    once = table(spark, d, "documents").where("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id").distinct()
    return once.groupBy("digest").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")


@query("semi_summarised", f"WITH {_COMMITS} SELECT commit_id, repository_name FROM c WHERE commit_id IN (SELECT commit_id FROM summary_commit)")
def semi_summarised(spark, d):
    return setjoin.keep_known(commits(spark, d), table(spark, d, "summary_commit"), ["commit_id"]).select("commit_id", "repository_name")


@query("anti_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_customers(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return setjoin.drop_known(table(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey")


@query("update_join", """WITH s AS (SELECT commit_id, any_value(optimization_summary_final) AS f, any_value(is_generic_optimization_final) AS g FROM summary_commit GROUP BY 1),
c AS (SELECT DISTINCT commit_id, message, contains_optimization_keyword AS k FROM all_commit)
SELECT c.commit_id, coalesce(s.f, c.message) AS message, coalesce(s.g, c.k) AS flag FROM c LEFT JOIN s USING (commit_id)""")
def update_join(spark, d):
    c = table(spark, d, "all_commit").select("commit_id", "message", F.col("contains_optimization_keyword").alias("flag")).distinct()
    s = table(spark, d, "summary_commit").select("commit_id", F.col("optimization_summary_final").alias("message"), F.col("is_generic_optimization_final").alias("flag"))
    return setjoin.update_fields(c, s, ["commit_id"], ["message", "flag"], ["message", "flag"])


@query("row_replace", "SELECT o_orderkey AS k, 'new' AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderstatus <> 'F'")
def row_replace(spark, d):
    o = table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.lit("old").alias("v"))
    new = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    return setjoin.replace_rows(old, new, ["k"])


@query("upsert_append", """WITH e AS (SELECT DISTINCT commit_id, 'true' AS label FROM all_commit WHERE is_opt_ds_simple = 'true'), a AS (SELECT DISTINCT commit_id FROM summary_commit)
SELECT commit_id, label FROM e UNION ALL SELECT commit_id, 'unknown' FROM a WHERE commit_id NOT IN (SELECT commit_id FROM e)""")
def upsert_append(spark, d):
    e = table(spark, d, "all_commit").where("is_opt_ds_simple = 'true'").select("commit_id", F.lit("true").alias("label")).distinct()
    return setjoin.append_new(e, table(spark, d, "summary_commit").select("commit_id"), ["commit_id"], {"label": F.lit("unknown")}, ["commit_id"])


@query("combine_missing", "SELECT DISTINCT a.cluster_id, k.cluster_id IS NOT NULL AS found, k.size AS size FROM assessment a LEFT JOIN (SELECT * FROM kmeans_50_10_true_summary WHERE size >= 16) k USING (cluster_id)")
def combine_missing(spark, d):
    a = table(spark, d, "assessment").select("cluster_id").distinct()
    k = table(spark, d, "kmeans_50_10_true_summary").where("size >= 16").select("cluster_id", "size")
    return setjoin.combine_with_missing(a, k, ["cluster_id"])


_TYPES = ["click", "view", "purchase", "login"]


@query("common_in_all", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_in_all(spark, d):
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    return setjoin.in_all([e.where(F.col("event_type") == k).select("user_id") for k in kinds], "user_id")


@query("common_in_both", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def common_in_both(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return setjoin.in_all([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")], "k")


@query("union_all_parts", "SELECT 'commit' AS origin, count(*) AS n FROM all_commit UNION ALL SELECT 'file', count(*) FROM modified_file UNION ALL SELECT 'assessment', count(*) FROM assessment")
def union_all_parts(spark, d):
    parts = [table(spark, d, t).select(F.lit(o).alias("origin")) for o, t in (("commit", "all_commit"), ("file", "modified_file"), ("assessment", "assessment"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("except_keys", "SELECT repository_name FROM all_commit EXCEPT SELECT repository FROM assessment")
def except_keys(spark, d):
    return table(spark, d, "all_commit").select("repository_name").subtract(table(spark, d, "assessment").select(F.col("repository").alias("repository_name")))


@query("tag_missing", "SELECT DISTINCT commit_id, CASE WHEN commit_id IN (SELECT commit_id FROM summary_commit) THEN 'known' ELSE 'tagged' END AS tag FROM all_commit")
def tag_missing(spark, d):
    out = setjoin.combine_with_missing(table(spark, d, "all_commit").select("commit_id").distinct(), table(spark, d, "summary_commit").select("commit_id").distinct(), ["commit_id"])
    return out.select("commit_id", F.when(F.col("found"), "known").otherwise("tagged").alias("tag"))


@query("child_to_parent", "SELECT a.commit_id AS child, b.commit_id AS parent FROM (SELECT DISTINCT commit_id FROM all_commit) a LEFT JOIN (SELECT DISTINCT commit_id FROM summary_commit) b ON a.commit_id - 1 = b.commit_id")
def child_to_parent(spark, d):
    a = table(spark, d, "all_commit").select(F.col("commit_id").alias("child")).distinct()
    b = table(spark, d, "summary_commit").select(F.col("commit_id").alias("parent")).distinct()
    return a.join(b, F.col("child") - 1 == F.col("parent"), "left")


_SPANS = "(VALUES (0, 400, 1, 'short'), (300, 900, 2, 'medium'), (800, 3000, 3, 'long'))"


@query("range_first", f"SELECT doc_id, n_chars, (SELECT arg_min(name, o) FROM {_SPANS} AS v(lo, hi, o, name) WHERE n_chars BETWEEN lo AND hi) AS name FROM (SELECT DISTINCT doc_id, n_chars FROM documents)")
def range_first(spark, d):
    spans = spark.createDataFrame([(0, 400, 1, "short"), (300, 900, 2, "medium"), (800, 3000, 3, "long")], "lo long, hi long, o int, name string")
    return setjoin.range_first(table(spark, d, "documents").select("doc_id", "n_chars").distinct(), spans, "n_chars", "lo", "hi", "o", "name", 500)


@query("cross_minus_done", "WITH s AS (SELECT DISTINCT commit_id FROM summary_commit), k AS (SELECT cluster_id FROM kmeans_50_10_true_summary WHERE size >= 30), done AS (SELECT DISTINCT cluster_id, assessment_id AS commit_id FROM assessment) SELECT commit_id, cluster_id FROM s, k WHERE (cluster_id, commit_id) NOT IN (SELECT cluster_id, commit_id FROM done)")
def cross_minus_done(spark, d):
    s = table(spark, d, "summary_commit").select("commit_id").distinct()
    k = table(spark, d, "kmeans_50_10_true_summary").where("size >= 30").select("cluster_id")
    done = table(spark, d, "assessment").select("cluster_id", F.col("assessment_id").alias("commit_id"))
    return setjoin.pairs_not_done(s, k, done, ["cluster_id", "commit_id"])


@query("bytes_by_kind", "SELECT kind, count(*) AS files, sum(n_bytes)::BIGINT AS bytes, round(sum(n_bytes) / 1048576.0, 6) AS mb FROM (SELECT DISTINCT file_id, kind, n_bytes FROM modified_file) GROUP BY ROLLUP (kind)")
def query_bytes_by_kind(spark, d):
    return bytes_by_kind(table(spark, d, "modified_file").select("file_id", "kind", "n_bytes").distinct(), "kind", "n_bytes")


@query("slice_parts", "SELECT o_orderkey, least(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 4000), 2)::INT AS slice FROM orders")
def slice_parts(spark, d):
    return windows.slices(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 4000, 3)


@query("quota_sample", """WITH c AS (SELECT DISTINCT commit_id, repository_name FROM all_commit), a AS (SELECT * FROM c WHERE repository_name = (SELECT min(repository_name) FROM c) ORDER BY commit_id LIMIT 50)
SELECT commit_id FROM a UNION ALL SELECT commit_id FROM (SELECT commit_id FROM c WHERE repository_name <> (SELECT min(repository_name) FROM c) OR repository_name IS NULL ORDER BY md5(commit_id::VARCHAR), commit_id LIMIT (SELECT 400 - count(*) FROM a))""")
def quota_sample(spark, d):
    c = table(spark, d, "all_commit").select("commit_id", "repository_name").distinct()
    first = c.agg(F.min("repository_name")).first()[0]
    return windows.quota_sample(c, F.col("repository_name") == first, 50, 400, ["commit_id"], [F.md5(F.col("commit_id").cast("string")), "commit_id"]).select("commit_id")


@query("first_success", "SELECT user_id, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) GROUP BY 1")
def first_success(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return windows.first_success(e, "user_id", "ts", F.lit(True), "event_id")


@query("sorted_repositories", "SELECT repository_name, count(DISTINCT commit_id) AS n FROM all_commit GROUP BY 1 ORDER BY n DESC, repository_name LIMIT 10")
def sorted_repositories(spark, d):
    once = table(spark, d, "all_commit").select("repository_name", "commit_id").distinct()
    return once.groupBy("repository_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repository_name").limit(10)


@query("known_answers", "SELECT r AS repository_name, EXISTS (SELECT 1 FROM all_commit WHERE repository_name = r) AS present FROM (VALUES ('foltwick-db'), ('no-such-repository')) AS v(r)")
def known_answers(spark, d):
    want = spark.createDataFrame([("foltwick-db",), ("no-such-repository",)], "repository_name string")
    return setjoin.combine_with_missing(want, table(spark, d, "all_commit").select("repository_name").distinct(), ["repository_name"], "present")
