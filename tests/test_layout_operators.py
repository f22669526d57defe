"""Eager aggregation and compaction: hot keys, nulls, repeated rows, empty tables, clashing columns."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators.compaction import compact
from tarnwork.operators.skew import eager_join_rollup
from tarnwork.staging import fresh_path


def brute(left, right):
    l = {r[0]: r for r in left}
    r_ = {r[0]: r for r in right}
    out = {}
    for g in {x[1] for x in [*l.values(), *r_.values()]}:
        ls, rs = [x for x in l.values() if x[1] == g], [x for x in r_.values() if x[1] == g]
        pairs = sum(1 for a in ls for b in rs if g is not None and a[2] is not None and a[2] == b[2])
        flags = [a[3] for a in ls if a[3] is not None]
        out[g] = (len(ls), len(rs), pairs, round(sum(flags) / len(flags), 6) if flags else None)
    return out


def rollup(l, r):
    return eager_join_rollup(l, r, keys=["g", "h"], group="g", left_id="i", right_id="i", left_flags={"f": F.col("f")}, right_flags={})


def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, g string, h string, f boolean, _n int, l_n int").select("i", "g", "h", "f", "_n", "l_n")


def test_eager_rollup_equals_brute_force(spark):
    rnd = random.Random(1)
    make = lambda n: [(i, rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice(["x", "y", "z", None]), rnd.choice([True, False, None]), 1, 2) for i in range(n)]
    left, right = make(300), make(200)
    left += left[:50]
    right += right[:9]
    got = {r.g: (r.n_left, r.n_right, r.n_pairs, r.f_rate) for r in rollup(frame(spark, left), frame(spark, right)).collect()}
    assert got == brute(left, right)


def test_eager_rollup_of_nothing(spark):
    assert rollup(frame(spark, []), frame(spark, [])).count() == 0
    only = rollup(frame(spark, [(1, "a", "x", None, 0, 0)]), frame(spark, [])).first()
    assert (only.n_left, only.n_right, only.n_pairs, only.f_rate) == (1, 0, 0, None)


SCHEMA = "file_id long, repo string, content string, __mark int, __bucket int"


@pytest.mark.parametrize("target", [10_000, 1 << 26])
def test_compaction_keeps_every_record_once(spark, target):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, "", "x" * rnd.randrange(2000)]), 7, 8) for i in range(400)]
    rows += [(401, "long", "y" * 300_000, 7, 8), (None, "b", "no id", 7, 8), (None, "b", "no id either", 7, 8)]
    df = spark.createDataFrame(rows + rows[:60], SCHEMA)
    dest = fresh_path(spark, "compact-test")
    report = compact(df, dest, row_id="file_id", cluster_by=["repo"], content="content", target_bytes=target)
    back = spark.read.parquet(dest)
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter(rows)
    assert report["rows"] == len(rows) and (report["files"] == 1) == (target > 1_000_000)
    again = compact(back, dest + "-2", row_id="file_id", cluster_by=["repo"], content="content", target_bytes=target)
    assert again["rows"] == len(rows)


def test_more_files_than_ranges(spark, monkeypatch):
    from tarnwork.operators import compaction

    monkeypatch.setattr(compaction, "MAX_RANGES", 2)
    rows = [(i, f"r{i % 7}", "x" * 100, 0, 0) for i in range(400)]
    dest = fresh_path(spark, "compact-ranges")
    compact(spark.createDataFrame(rows, SCHEMA), dest, row_id="file_id", cluster_by=["repo"], content="content", target_bytes=8_000)
    back = spark.read.parquet(dest)
    assert back.count() == 400 and 8 <= len(back.inputFiles()) <= 12


def test_compaction_swaps_only_after_reconciling(spark):
    dest = fresh_path(spark, "compact-swap")
    df = spark.createDataFrame([(1, "a", "one", 0, 0)], SCHEMA)
    compact(df, dest, row_id="file_id", cluster_by=["repo"], content="content")
    compact(spark.createDataFrame([(2, "a", "two", 0, 0)], SCHEMA), dest, row_id="file_id", cluster_by=["repo"], content="content")
    assert [r.file_id for r in spark.read.parquet(dest).collect()] == [2]


def test_compaction_of_an_empty_table(spark):
    dest = fresh_path(spark, "compact-empty")
    assert compact(spark.createDataFrame([], SCHEMA), dest, row_id="file_id", cluster_by=["repo"], content="content")["rows"] == 0
    assert spark.read.parquet(dest).count() == 0


def test_compaction_keeps_the_first_delivery(spark):
    rows = [(1, "a", "one", 5, 0), (1, "a", "one", 3, 0), (1, "a", "one", 9, 0), (2, "a", "two", 4, 0), (2, "a", "other two", 4, 0), (3, "b", None, 2, 0), (3, "b", None, 1, 0)]
    want = {(1, "one", 3), (2, "two", 4), (2, "other two", 4), (3, None, 1)}
    for moved in (False, True):
        given = [*rows, (1, "elsewhere", "one", 8, 0)] if moved else rows
        dest = fresh_path(spark, "compact-first")
        compact(spark.createDataFrame(given, SCHEMA).repartition(5), dest, row_id="file_id", cluster_by=["repo"], content="content", first_by=["__mark"], target_bytes=100)
        back = [(r.file_id, r.content, r["__mark"]) for r in spark.read.parquet(dest).collect()]
        assert len(back) == 4 and set(back) == want
