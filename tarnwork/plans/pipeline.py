"""A pipeline is a list of named steps from tables to a table; each result is written once and read by later steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import funnel, windows
from tarnwork.staging import path_exists

Step = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def run(spark: SparkSession, steps: list[Step], tables: dict[str, DataFrame], root: str, overwrite: bool = False) -> dict[str, DataFrame]:
    """Runs the steps in order; a step whose table exists is skipped unless ``overwrite``, so a killed run goes on."""
    known = dict(tables)
    for name, step in steps:
        path = f"{root}/{name}"
        if overwrite or not path_exists(spark, f"{path}/_SUCCESS"):
            step(known).write.mode("overwrite").parquet(path)
        known[name] = spark.read.parquet(path)
    return known


#: From commits as mined to labelled single-function changes, cheap filters first.
FUNNEL: list[Step] = [
    ("one_file", lambda t: t["commits"].where(funnel.one_file())),
    ("c_language", lambda t: t["one_file"].where(funnel.first_file_is_c())),
    ("is_opt_keyword", lambda t: t["c_language"].where(funnel.keyword_hit())),
    ("one_func", lambda t: t["is_opt_keyword"].where(funnel.one_function())),
    ("deduplicated", lambda t: windows.first_per_key(t["one_func"], ["hash", "message"], [F.asc_nulls_first("repository_name"), "commit_id"])),
    ("is_opt_final", lambda t: t["deduplicated"].where(F.lower("is_opt_ds_simple") == "true")),
]
