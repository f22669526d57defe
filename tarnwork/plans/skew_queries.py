"""Queries of the core data-layout operators (p1_, p2_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.compaction import compact
from tarnwork.operators.skew import eager_join_rollup
from tarnwork.sources.tables import table
from tarnwork.staging import fresh_path


def p1_repository_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, assessments, (commit, assessment) pairs and flag rates of every repository."""
    a = table(spark, sf_dir, "assessment").withColumnsRenamed({"repository": "repository_name", "commit_hash": "hash"})
    out = eager_join_rollup(
        table(spark, sf_dir, "all_commit"),
        a,
        keys=["repository_name", "hash"],
        group="repository_name",
        left_id="commit_id",
        right_id="assessment_id",
        left_flags={
            "keyword": F.col("contains_optimization_keyword"),
            "modified_other": F.col("modified_other"),
            "is_opt": F.col("is_opt_ds_simple") == "true",
        },
        right_flags={"voting": F.col("voting_result")},
    )
    return out.withColumnsRenamed({"n_left": "n_commits", "n_right": "n_assessments"})


P1_SQL = """
WITH c AS (SELECT commit_id, any_value(repository_name) AS repository_name, any_value(hash) AS hash,
                  bool_or(contains_optimization_keyword) AS k, bool_or(modified_other) AS m, bool_or(is_opt_ds_simple = 'true') AS o
           FROM all_commit GROUP BY commit_id),
     a AS (SELECT assessment_id, any_value(repository) AS repository_name, any_value(commit_hash) AS hash, bool_or(voting_result) AS v
           FROM assessment GROUP BY assessment_id),
     g AS (SELECT repository_name FROM c UNION SELECT repository_name FROM a),
     cs AS (SELECT repository_name, count(*) AS n, avg(k::int) AS k, avg(m::int) AS m, avg(o::int) AS o FROM c GROUP BY 1),
     av AS (SELECT repository_name, count(*) AS n, avg(v::int) AS v FROM a GROUP BY 1),
     ps AS (SELECT c.repository_name, count(*) AS n FROM c JOIN a ON c.repository_name = a.repository_name AND c.hash = a.hash GROUP BY 1)
SELECT g.repository_name, coalesce(cs.n, 0) AS n_commits, coalesce(av.n, 0) AS n_assessments, coalesce(ps.n, 0) AS n_pairs,
       round(cs.k, 6) AS keyword_rate, round(cs.m, 6) AS modified_other_rate, round(cs.o, 6) AS is_opt_rate, round(av.v, 6) AS voting_rate
FROM g LEFT JOIN cs ON g.repository_name IS NOT DISTINCT FROM cs.repository_name
       LEFT JOIN av ON g.repository_name IS NOT DISTINCT FROM av.repository_name
       LEFT JOIN ps ON g.repository_name IS NOT DISTINCT FROM ps.repository_name
"""


def p2_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """modified_file consolidated; the rows read back from the new files, with a content digest."""
    dest = fresh_path(spark, "modified_file_compacted")
    compact(table(spark, sf_dir, "modified_file"), dest, row_id="file_id", cluster_by=["repository_name", "hash", "kind"], content="content", first_by=["loaded_at"])
    back = spark.read.parquet(dest)
    return back.select("file_id", "repository_name", "hash", "kind", "file_path", "n_bytes", "loaded_at", F.md5(F.col("content").cast("binary")).alias("content_md5"))


P2_SQL = """
SELECT file_id, repository_name, hash, kind, file_path, n_bytes, min(loaded_at) AS loaded_at, md5(content) AS content_md5 FROM modified_file GROUP BY ALL
"""


QUERIES = {"p1_repository_rates": p1_repository_rates, "p2_compacted": p2_compacted}
SQL = {"p1_repository_rates": P1_SQL, "p2_compacted": P2_SQL}
