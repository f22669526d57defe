"""Queries that write a table by a sink and read it again by a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.vectors import embed_with_cache
from tarnwork.operators import sinks
from tarnwork.plans.funnel_queries import _COMMITS, commits
from tarnwork.plans.registry import Registry
from tarnwork.sources import files, search
from tarnwork.sources.tables import table
from tarnwork.staging import fresh_path

query = Registry()
QUERIES, SQL = query.queries, query.sql

_FIELDS = "repository_name, hash, md5(message) AS message, date, modified_files_count, len(modified_files) AS files"


def _digest(df):
    return df.select("repository_name", "hash", F.md5(F.col("message").cast("binary")).alias("message"), "date", "modified_files_count", F.when(F.col("modified_files").isNotNull(), F.size("modified_files")).cast("long").alias("files"))


@query("json_round_trip", f"WITH {_COMMITS} SELECT {_FIELDS} FROM c")
def json_round_trip(spark, d):
    path = fresh_path(spark, "commits_json")
    sinks.write_json(commits(spark, d).select("repository_name", *[c.split()[0] for c in files.COMMIT.split(", ")]), path)
    return _digest(files.commits(spark, path, lines=True))


@query("json_by_repository", f"WITH {_COMMITS} SELECT {_FIELDS} FROM c")
def json_by_repository(spark, d):
    path = fresh_path(spark, "commits_by_repository")
    sinks.write_json(commits(spark, d).select("repository_name", *[c.split()[0] for c in files.COMMIT.split(", ")]).repartition("repository_name", F.pmod(F.xxhash64("hash"), F.lit(8))), path, partition_by=["repository_name"])
    return _digest(files.commits_by_repository(spark, path, lines=True))


@query("sorted_csv", "SELECT repository_name, count(DISTINCT commit_id) AS n FROM all_commit WHERE repository_name IS NOT NULL GROUP BY 1")
def sorted_csv(spark, d):
    path = fresh_path(spark, "csv")
    per = table(spark, d, "all_commit").where("repository_name IS NOT NULL").groupBy("repository_name").agg(F.count_distinct("commit_id").alias("n"))
    sinks.write_sorted_csv(per, path, ["repository_name"])
    return spark.read.schema("repository_name string, n long").option("header", True).csv(path)


@query("text_files", "SELECT cluster_id AS name, md5(coalesce(llm_summary.strategy_summary, '') || chr(10)) AS digest, octet_length((coalesce(llm_summary.strategy_summary, '') || chr(10))::BLOB) AS length, true AS valid_utf8 FROM kmeans_50_10_true_summary")
def text_files(spark, d):
    """Each summary as a text file, listed and read back with its folder's name."""
    path = fresh_path(spark, "texts")
    sinks.write_texts(table(spark, d, "kmeans_50_10_true_summary").select("cluster_id", F.col("llm_summary.strategy_summary").alias("t")), path, "cluster_id", "t")
    listed = files.listing(spark, path).where("name LIKE 'part-%'").select("path", F.regexp_extract("parent", "=(.*)$", 1).alias("folder"), "length")
    read = files.text_tree(spark, path, "part-*").select("path", "content", "valid_utf8")
    return listed.join(read, "path").select(F.col("folder").alias("name"), F.md5(F.col("content").cast("binary")).alias("digest"), "length", "valid_utf8")


@query("cluster_map", "SELECT cluster_id, size, used_commits_count, consistency_best_idx FROM kmeans_50_10_true_summary")
def cluster_map(spark, d):
    """The fixed table of clusters as one JSON object by id, read as rows."""
    path = fresh_path(spark, "clusters")
    k = table(spark, d, "kmeans_50_10_true_summary").select("cluster_id", F.struct("size", "used_commits_count", "consistency_best_idx").alias("c"))
    k.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("cluster_id", "c")))).alias("value")).write.text(path)
    return files.clusters(spark, path, "size:int,used_commits_count:int,consistency_best_idx:int")


@query("reject_file", f"WITH {_COMMITS} SELECT commit_id::VARCHAR || ': no repository' AS line FROM c WHERE github_commit_url IS NULL")
def reject_file(spark, d):
    path = fresh_path(spark, "rejects")
    sinks.write_rejects(commits(spark, d).where("github_commit_url IS NULL").select("commit_id", F.lit("no repository").alias("reason")), path, "commit_id")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("resumed_results", f"WITH {_COMMITS} SELECT commit_id, length(message) AS n FROM c")
def resumed_results(spark, d):
    """In three slices, started again: nothing is done twice."""
    path = fresh_path(spark, "resumed")
    work = lambda df: df.select("commit_id", F.length("message").alias("n"))
    todo = commits(spark, d)
    sinks.resume(spark, todo.where("commit_id % 3 = 0"), ["commit_id"], path, work)
    return sinks.resume(spark, todo, ["commit_id"], path, work, batches=3)


@query("chosen_readmes", "SELECT repository_name, CASE length(repository_name) % 3 WHEN 0 THEN 'README.md' WHEN 1 THEN 'README.rst' ELSE 'docs/README.md' END AS path FROM (SELECT DISTINCT repository_name FROM all_commit WHERE repository_name IS NOT NULL)")
def chosen_readmes(spark, d):
    r = table(spark, d, "all_commit").where("repository_name IS NOT NULL").select("repository_name").distinct()
    have = F.array(F.lit("docs/README.md"), F.lit("src/README.md"), F.when(F.length("repository_name") % 3 == 0, F.lit("README.md")), F.when(F.length("repository_name") % 3 < 2, F.lit("README.rst")))
    return files.choose_readme(r.select("repository_name", F.explode(F.array_compact(have)).alias("path")), "repository_name", "path")


@query("numbered_attempts", "SELECT answer_id::VARCHAR || '.txt' AS name, answer_id::INT AS attempt FROM (SELECT DISTINCT answer_id FROM individual_assessments) WHERE answer_id % 2 = 0")
def numbered_attempts(spark, d):
    a = table(spark, d, "individual_assessments").select("answer_id").distinct()
    names = a.select(F.concat(F.when(F.col("answer_id") % 2 == 0, F.lit("")).otherwise(F.lit("exp")), F.col("answer_id").cast("string"), F.lit(".txt")).alias("name"))
    return files.attempt_files(names).select("name", "attempt")


@query("interval_search", "SELECT p_partkey::VARCHAR AS name, p_name AS url, p_partkey AS value, p_size::BIGINT AS size_kb FROM part WHERE p_size <= 40")
def interval_search(spark, d):
    """Every part by a search that gives 150 results at most, in halves of its interval and pages."""
    spark.dataSource.register(search.IntervalSearchSource)
    options = {"client": "tarnwork.sources.search:parquet_client", "path": f"{d}/part.parquet", "fields": "p_partkey,p_name,p_partkey,p_size", "lo": 0, "hi": 1 << 30, "most": 150, "largest_kb": 40}
    return spark.read.format("interval_search").options(**options).load()


@query("cached_embeddings", "SELECT doc_id, text IS NULL OR text = '' AS empty, doc_id % 2 = 0 AS was_cached FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE doc_id % 2 = 0")
def cached_embeddings(spark, d):
    """Embeddings of texts, found in a cache of the texts' digests; the cache is filled by a first pass over half of the rows."""
    t = table(spark, d, "documents").select("doc_id", "text").distinct()
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    _, cache = embed_with_cache(t.where("doc_id % 2 = 0"), "text", empty)
    path = fresh_path(spark, "embedding_cache")
    cache.write.parquet(path)
    cached = spark.read.parquet(path)
    out, fresh = embed_with_cache(t.where("doc_id % 2 = 0"), "text", cached)
    known = fresh.count() == 0
    return out.select("doc_id", (F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) == 0).alias("empty"), F.lit(known).alias("was_cached"))
