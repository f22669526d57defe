"""Queries of the llm subpackage and their SQL (where SQL can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import consensus, leakage, mojibake, pairs, reading, similarity, syntax, tokenize
from tarnwork.sources.tables import table


def _ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = table(spark, sf_dir, "summary_commit")
    final = commits.select(F.col("commit_id").alias("record_id"), F.col("optimization_summary_final").alias("text"))
    described = commits.select(F.col("commit_id").alias("record_id"), F.filter("optimization_summary", lambda x: x.isNotNull()).alias("texts"))
    return similarity.assign(final, described)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of commit_pair whose commits are in one group that is a recurring idea."""
    group = _ideas(spark, sf_dir).where("recurring").select("record_id", "cluster_id")
    given = table(spark, sf_dir, "commit_pair").select(F.least("commit_id_a", "commit_id_b").alias("commit_id_a"), F.greatest("commit_id_a", "commit_id_b").alias("commit_id_b")).where("commit_id_a < commit_id_b").distinct()
    a = group.withColumnsRenamed({"record_id": "commit_id_a", "cluster_id": "a"})
    b = group.withColumnsRenamed({"record_id": "commit_id_b", "cluster_id": "b"})
    return given.join(a, "commit_id_a").join(b, "commit_id_b").where("a = b").select("commit_id_a", "commit_id_b")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cluster_table(_ideas(spark, sf_dir))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "modified_file").where("kind IN ('before_func', 'after_func')")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(_functions(spark, sf_dir), file_id="file_id", path="file_path", content="content").select("file_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _functions(spark, sf_dir)
    bad = syntax.invalid_files(files, file_id="file_id", path="file_path", content="content")
    return syntax.invalid_rates(files, bad, file_id="file_id", path="file_path", content="content", repository="repository_name")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "individual_assessments").where("error IS NULL").select(F.lit("answer").alias("origin"), F.col("answer_id").alias("record_id"), F.lit(0).alias("item"), "question", "explanation", "code_to_optimize", "optimized_code")
    texts = rows.select("origin", "record_id", "item", F.lit("explanation").alias("kind"), "question", F.col("explanation").alias("answer"))
    # both code fields are null, rightly, when the answer is "not applicable"
    codes = rows.where("code_to_optimize IS NOT NULL OR optimized_code IS NOT NULL").select("origin", "record_id", "item", F.lit("code").alias("kind"), F.col("code_to_optimize").alias("question"), F.col("optimized_code").alias("answer"))
    commits = table(spark, sf_dir, "summary_commit").select(F.lit("summary").alias("origin"), F.col("commit_id").alias("record_id"), F.posexplode("optimization_summary").alias("k", "answer"), F.col("message").alias("question"))
    summaries = commits.select("origin", "record_id", (F.col("k") + 1).alias("item"), F.lit("summary").alias("kind"), "question", "answer")
    return texts.unionByName(codes).unionByName(summaries)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_defects(_answers(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _written_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "all_commit").select(F.lit("message").alias("origin"), F.col("commit_id").alias("record_id"), F.col("message").alias("text"))
    diffs = table(spark, sf_dir, "modified_file").where("kind = 'diff'").select(F.lit("diff").alias("origin"), F.col("file_id").alias("record_id"), F.col("content").alias("text"))
    return messages.unionByName(diffs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(_written_records(spark, sf_dir), "text")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore_text(_written_records(spark, sf_dir), "text")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "individual_assessments").select(
        F.lit("assessment").alias("origin"), F.col("assessment_id").alias("record_id"), F.col("answer_id").alias("vote_id"), consensus.clean_rater(F.col("rater")).alias("rater"), F.col("final_applicable").alias("label")
    )
    commits = table(spark, sf_dir, "summary_commit").select(F.col("commit_id").alias("record_id"), F.posexplode("is_generic_optimization").alias("k", "label"))
    generic = commits.select(F.lit("commit").alias("origin"), "record_id", F.col("k").cast("long").alias("vote_id"), F.concat(F.lit("position_"), F.lpad((F.col("k") + 1).cast("string"), 2, "0")).alias("rater"), "label")
    return answers.unionByName(generic)


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(_votes(spark, sf_dir))[0]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_items(spark, sf_dir).where("consensus").select("origin", "record_id")


def p6_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.rater_table(_votes(spark, sf_dir))


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement_table(_votes(spark, sf_dir))


P6_AGREEMENT_SQL = """
WITH v AS (
  SELECT DISTINCT 'assessment' AS origin, assessment_id AS record_id, answer_id AS vote_id, final_applicable AS label
  FROM individual_assessments WHERE final_applicable IS NOT NULL
  UNION ALL
  SELECT 'commit', commit_id, k, is_generic_optimization[k]
  FROM (SELECT DISTINCT commit_id, is_generic_optimization, unnest(generate_series(1, len(is_generic_optimization))) AS k FROM summary_commit)
  WHERE is_generic_optimization[k] IS NOT NULL),
per AS (SELECT origin, record_id, count(*) AS m, count(*) FILTER (label) AS t FROM v GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT origin, count(*) AS n_items, sum(m) AS n, sum(t) AS t, sum(2.0 * t * (m - t) / (m - 1)) AS o FROM per GROUP BY origin)
SELECT origin, n_items, n::BIGINT AS n_votes, round(1 - o / (2.0 * t * (n - t) / (n - 1)), 6) AS alpha FROM s
"""


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), doc_id="doc_id", text="text", item_id="item_id", item_text="item_text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_example"), table(spark, sf_dir, "eval_item"), doc_id="doc_id", text="text", kind="doc_kind")


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_items": p6_items, "p6_raters": p6_raters, "p6_agreement": p6_agreement, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found}
SQL: dict[str, str] = {"p6_agreement": P6_AGREEMENT_SQL}
