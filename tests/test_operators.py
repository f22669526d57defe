"""Hand-computed cases of single operators and brute-force checks of search and clustering."""

import math
import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.functions.vectors import cosine, embed, embed_with_cache
from tarnwork.operators import clusters, codefn, completions, funnel, perf, setjoin, sinks, topk, votes, windows
from tarnwork.sources import files
from tarnwork.sources.git import GitLogSource
from tarnwork.staging import fresh_path
from tarnwork.streaming import incremental


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first().x


def test_text_functions(spark):
    c = F.col("c")
    assert one(spark, T.strip(c), c="\n\t a b  \n") == "a b"
    assert one(spark, T.extension(c), c="dir.d/File.CPP") == ".cpp"
    assert one(spark, T.extension(c), c=".gitignore") == ""
    assert one(spark, T.split_key(c, "_")["tail"], c="a_b_c") == "b_c"
    assert one(spark, T.split_key(c, "_")["tail"], c="abc") is None
    assert one(spark, T.fenced_blocks(c), c="x\n```cpp\nint a;\n```\ny ```b```") == ["int a;", "b"]
    assert one(spark, T.single_block(c), c="```a```\n```b```") is None
    assert one(spark, T.unwrap_fence(c), c="```c\nint a;\nint b;\n```") == "int a;\nint b;"
    assert one(spark, T.labelled(c, "Summary"), c="summary: one\nSUMMARY: two ") == "two"
    assert one(spark, T.labelled(c, "Summary"), c="none") is None
    assert one(spark, T.equivalent_flag(c), c="x\nEquivalent:  TRUE") is True
    assert one(spark, T.before_and_after(c)["after"], c="```a```\n```b```") == "b"
    assert one(spark, T.json_answer(c)["applicable"], c='```json\n{"applicable": false, "explanation": "x"}\n```') is False
    assert one(spark, T.json_answer(c)["applicable"], c="it is true that it is applicable") is True
    assert len(one(spark, T.json_answer(c)["explanation"], c="z" * 900)) == 500
    assert one(spark, T.conditions(c), c="1. First. More\n2. Second\n- Third! x\n4. Fourth") == ["First.", "Second", "Third!"]
    assert one(spark, T.code_pairs(c), c='[["a","b"]]') == [["a", "b"]] and one(spark, T.code_pairs(c), c="no") == []
    assert one(spark, T.says_similar(c), c="dissimilar") is True and one(spark, T.says_similar(c, strict=True), c="dissimilar") is False
    assert one(spark, T.tri_state(c), c=" TRUE ") == "true" and one(spark, T.tri_state(c), c="yes") == "unknown"
    assert one(spark, T.word_tokens(c), c="Aa _x bb1c été a") in (["aa", "bb", "ete"], ["aa", "bb", "été"])
    assert one(spark, T.word_count(c), c="a b, c") == 4


def test_survival_curve(spark):
    df = spark.createDataFrame([(n,) for n in [8, 3, 2, 2, 2, 2, 2, 1, 1, 1]], "n int")
    assert {r.n: r.clusters for r in windows.survival_curve(df, "n").collect()} == {8: 1, 3: 2, 2: 7, 1: 10}


def test_budgeted_pick_takes_a_long_last_row(spark):
    df = spark.createDataFrame([("c", 1, 5000), ("c", 2, None), ("c", 3, 9000)], "c string, o int, n int")
    got = windows.budgeted_pick(df, "c", ["o"], "n").orderBy("picked").collect()
    assert [(r.o, r.truncated) for r in got] == [(2, False), (3, True)]


def test_ranks_of_a_group_over_several_ranges(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot"] * 9 + ["a", None]), i, rnd.randrange(50)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, s int")
    got = {r.k: r["rank"] for r in windows.rank_in_group(df, ["g"], [F.desc("s"), "k"]).collect()}
    for g in ("hot", "a", None):
        assert [k for _, k in sorted((-s, k) for h, k, s in rows if h == g)] == sorted((k for h, k, _ in rows if h == g), key=got.get)
        assert sorted(got[k] for h, k, _ in rows if h == g) == list(range(1, sum(h == g for h, _, _ in rows) + 1))


def test_votes_ties_nulls_and_na(spark):
    df = spark.createDataFrame([(1, True, 2, "b"), (1, False, 1, "a"), (2, None, 1, "c"), (3, True, 1, "d"), (3, True, 2, "e"), (3, False, 3, "f")], "k int, v boolean, t int, e string")
    got = {r.k: (r.winner, r.confidence, r.explanation) for r in votes.majority_vote(df, ["k"], "v", "t", "e").collect()}
    assert got == {1: (False, 0.5, "a"), 3: (True, 0.666667, "d")}
    assert {r.k: r.passed for r in votes.strict_majority(df, ["k"], "v").collect()} == {1: False, 3: True}


def test_centrality_equals_pairwise_mean(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((40, 5))
    x[3] = 0
    df = spark.createDataFrame([(i, i % 3 if i < 39 else 9, [float(v) for v in x[i]]) for i in range(40)], "k int, g int, v array<double>")
    got = {r.k: r.score for r in votes.centrality(df, "g", "k", "v").collect()}
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    for i in range(39):
        others = [j for j in range(39) if j % 3 == i % 3 and j != i]
        assert got[i] == pytest.approx(np.mean([u[i] @ u[j] for j in others]), abs=1e-9)
    assert got[39] == 0


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("x")).first().x == 0


def test_cosine_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(2)
    x = np.round(rnd.standard_normal((120, 4)), 1)
    rows = [(i, [float(v) for v in x[i]] if i != 7 else None, str(i % 5) if i % 11 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g string")
    got = topk.cosine_topk(df.unionByName(df.limit(10)), df.where("id % 20 = 0"), id="id", vector="v", group="g", k=5).collect()
    x = x.astype("float32").astype("float64")
    x[7] = 0
    n = np.linalg.norm(x, axis=1)
    for q in range(0, 120, 20):
        s = [(-round(float(x[q] @ x[j] / (n[q] * n[j])) if n[q] * n[j] else 0.0, 9), j) for j in range(120) if j != q and (rows[j][2] != rows[q][2] or rows[q][2] is None)]
        assert [r.d_id for r in sorted((r for r in got if r.q_id == q), key=lambda r: r["rank"])] == [j for _, j in sorted(s)[:5]]


def test_bm25_by_hand(spark):
    docs = [(1, "a", "sort sort list"), (2, "b", "sort tree"), (3, "b", "heap"), (4, "b", ""), (5, "c", None)]
    df = spark.createDataFrame(docs, "id long, g string, t string")
    got = {r.d_id: (r["rank"], r.score) for r in topk.bm25_topk(df, df.where("id = 1"), id="id", text="t", group="g", k=4).collect()}
    n, avgdl = 5, (3 + 2 + 1) / 5
    idf_sort = math.log(n - 2 + 0.5) - math.log(2.5)
    score = 2 * idf_sort * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * 2 / avgdl))
    assert got[2][0] == 1 and got[2][1] == pytest.approx(score, abs=1e-8)
    assert [got[i][0] for i in (3, 4, 5)] == [2, 3, 4]  # score 0 ranks too, by id
    assert topk.bm25_topk(df, df.where("id = 4"), id="id", text="t", group="g").count() == 0


def test_set_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "n"), (1, "m"), (9, "q")], "k int, v string")
    assert {r.k for r in setjoin.drop_known(a, b, ["k"]).collect()} == {2, None}
    assert {(r.k, r.v) for r in setjoin.update_fields(a, b, ["k"], ["v"], ["v"]).collect()} == {(1, "m"), (2, "y"), (None, "z")}
    assert {(r.k, r.v) for r in setjoin.append_new(a, b, ["k"], {"v": F.lit("unknown")}, ["v"]).collect()} == {(1, "x"), (2, "y"), (None, "z"), (9, "unknown")}
    assert setjoin.pairs_not_done(a, b.limit(0).withColumnRenamed("k", "c").select("c"), a, ["k"]).count() == 0


def test_db_bench_and_redis_logs(spark):
    log = "x\nfillseq      :       2.5 micros/op 399,000 ops/sec 2.506 seconds 1,000,000 operations;   44.1 MB/s\nreadrandom : 3.0 micros/op 1 ops/sec 2 seconds 3 operations; 5 MB/s (6 of 7 found)\nreadrandom : 4.0 micros/op 1 ops/sec 2 seconds 3 operations; 5 MB/s (6 of 7 found)"
    df = spark.createDataFrame([("h", log), ("e", ""), ("n", None)], "hash string, t string")
    got = {(r.bench, r.metric): r.value for r in perf.parse_db_bench(df, "t").collect()}
    assert got[("fillseq", "ops_per_sec")] == 399000 and got[("readrandom", "micros_per_op")] == 4.0 and got[("readrandom", "total_found")] == 7
    assert ("fillseq", "found") not in got
    red = "====== SET ======\n  throughput summary: 100.5 requests per second\n  latency summary (msec):\n   avg min p50 p95 p99 max\n   0.1 0.2 0.3 0.4 0.5 0.6\n====== GET ======\n  throughput summary: 7 requests per second\n  latency summary (msec):\n   avg min\n   0.1 0.2\n"
    got = {(r.bench, r.metric): r.value for r in perf.parse_redis(spark.createDataFrame([("h", red)], "hash string, t string"), "t").collect()}
    assert got[("SET", "throughput")] == 100.5 and got[("SET", "p99")] == 0.5 and got[("GET", "throughput")] == 7 and ("GET", "avg") not in got


def test_verdict_ties_and_missing(spark):
    rows = [("h", "A", "seconds", 2.0, 1.0), ("h", "A", "ops_per_sec", 2.0, 1.0), ("h", "N", "other", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "hash string, bench string, metric string, base double, other double")
    assert {r.bench: r.verdict for r in perf.verdicts(df, ["hash"]).collect()} == {"A": "no change", "N": "no change"}
    assert {r.bench: r.verdict for r in perf.verdicts(df, ["hash"], tie="worse").collect()} == {"A": "worse", "N": "no change"}
    assert perf.category(perf.verdicts(df, ["hash"]), ["hash"], ("A", "N")).first().category == "uncategorised"


SOURCE = """#include <x>
int one(int a) { return a; }

static long two(struct s *p,
                size_t n)
{
  if (n) {
    p->x++;
  }
  return n;
}
Status Shard::three(const K& k) const {
  return Ok();
}
void declared(int a);
Foo::Foo(int a)
  : a_(a) {
}
"""


def test_functions_and_changes():
    assert codefn.function_spans(SOURCE) == [("one", 2, 2), ("two", 4, 11), ("Shard::three", 12, 14), ("Foo::Foo", 16, 18)]
    assert codefn.function_spans(None) == [] and codefn.function_spans("void open() {\n  if (a) {\n") == []
    after = SOURCE.replace("p->x++;", "p->x += 2;").replace("#include <x>", "#include <y>")
    got = codefn.changes(SOURCE, after)
    assert [(c[1], c[6]) for c in got] == [("replace", None), ("replace", "two")]
    assert codefn.function_text(SOURCE, "Shard::three").endswith("}")


def test_code_columns(spark):
    assert one(spark, codefn.splice(F.col("c"), F.lit(2), F.lit(3), F.lit("X")), c="a\nb\nc\nd") == "a\nX\nd"
    assert one(spark, codefn.add_include(F.col("c"), "<v>"), c="#pragma once\nx") == "#pragma once\n#include <v>\nx"
    df = spark.createDataFrame([(1, SOURCE, None), (2, None, SOURCE), (3, None, None)], "k int, b string, a string")
    assert {r.k for r in codefn.attribute_changes(df, ["k"], "b", "a").collect()} == {1, 2}
    assert codefn.parse_functions(df, ["k"], "b").count() == 4


def test_clustering():
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(c, 0.05, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [np.array([[10.0, 10.0]])])
    labels = clusters.ward_labels(x[:-1], 3)
    assert [len(set(labels[i : i + 30])) for i in (0, 30, 60)] == [1, 1, 1] and len(set(labels)) == 3
    dens = clusters.density_labels(x, 5, 5)
    assert len(set(dens[:90]) - {-1}) == 3 and dens[-1] == -1
    assert clusters.silhouette(x[:-1], labels) > 0.9 and clusters.silhouette(x[:3], np.array([0, 0, 0])) == -1
    assert list(clusters.density_labels(x[:1])) == [-1]


def test_quadratic_methods_refuse_large_tables(spark, monkeypatch):
    monkeypatch.setattr(clusters, "QUADRATIC_ROWS", 3)
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "k int, v array<double>")
    with pytest.raises(ValueError):
        clusters.ward(df, "k", "v", 2)


def test_completions_fail_replay_and_resume(spark):
    df = spark.createDataFrame([(1, "reserve", None), (2, "plain", "d")], "k int, message string, diff string")
    task = completions.TASKS["summarise_commit"]
    out = completions.run(df, ["k"], task)
    assert out.count() == 10 and {r.generic for r in out.where("k = 1").collect()} == {True}
    done = out.where("attempt < 5").select("k", "attempt")
    assert completions.run(df, ["k"], task, done=done).count() == 2

    def broken(prompts):
        raise RuntimeError

    assert {r.status for r in completions.run(df, ["k"], task, provider=broken).collect()} == {"error"}
    stored = spark.createDataFrame([(1, 1, "Summary: a\nGeneric: true")], "k int, attempt int, content string")
    got = completions.replay(df, stored, ["k"], task)
    assert got.where("status = 'success'").count() == 1 and got.count() == 10


def test_embedding_cache(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "k int, t string")
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    full, fresh = embed_with_cache(df, "t", empty)
    assert full.count() == 3 and fresh.count() == 2
    assert embed_with_cache(df, "t", fresh)[1].count() == 0
    assert embed(df, "t").where("embedding IS NULL").count() == 0


def test_funnel_rejects(spark):
    df = spark.createDataFrame([(1, ["a.c"]), (2, []), (3, None)], "n int, f array<string>")
    kept, lost = funnel.split_rejects(df, [("c", funnel.first_file_is_c("f")), ("one", F.col("n") < 3)])
    assert [r.n for r in kept.collect()] == [1] and {r.n: r.reason for r in lost.collect()} == {2: "c", 3: "c,one"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "kb" / "repo_a").mkdir(parents=True)
    (tmp_path / "kb" / "repo_a" / "all_commit.json").write_text('[{"hash": "h1", "message": "m"}, {"hash": "h2", "modified_files_count": 1}]')
    got = files.commits_by_repository(spark, str(tmp_path / "kb")).collect()
    assert {(r.repository_name, r.hash, r.modified_files_count) for r in got} == {("repo_a", "h1", None), ("repo_a", "h2", 1)}
    (tmp_path / "clusters.json").write_text('{"7": {"size": 3}, "8": {"size": 4}}')
    assert {(r.cluster_id, r.size) for r in files.clusters(spark, str(tmp_path / "clusters.json"), "size:int").collect()} == {("7", 3), ("8", 4)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_bytes("grün".encode("latin-1"))
    (tmp_path / "t" / "x.txt").write_text("grün")
    assert {(r.content, r.valid_utf8) for r in files.text_tree(spark, str(tmp_path / "t")).collect()} == {("grün", False), ("grün", True)}
    assert [r.attempt for r in files.attempt_files(files.listing(spark, str(tmp_path / "t"))).collect()] == [1]
    readmes = spark.createDataFrame([("r", "readme.md"), ("r", "README.rst"), ("q", "docs/README.md"), ("p", "x.md")], "repo string, path string")
    assert {r.repo: r.path for r in files.choose_readme(readmes, "repo", "path").collect()} == {"r": "readme.md", "q": "docs/README.md"}
    assert files.results_by_interval(1, 8, lambda a, b: (b - a + 1) * 400) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    df = spark.createDataFrame([(2, "b", "r2"), (1, "a", "r1")], "k int, v string, reason string")
    sinks.write_sorted_csv(df, str(tmp_path / "csv"), ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_rejects(df, str(tmp_path / "rej"), "v")
    assert {r.value for r in spark.read.text(str(tmp_path / "rej")).collect()} == {"b: r2", "a: r1"}
    sinks.write_json(df, str(tmp_path / "json"), ["v"])
    sinks.write_texts(df, str(tmp_path / "txt"), "k", "v")
    calls = []

    def work(part):
        calls.append(part.count())
        return part

    path = str(tmp_path / "res")
    assert sinks.resume(spark, df, ["k"], path, work, batches=2).count() == 2
    assert sinks.resume(spark, df, ["k"], path, work).count() == 2 and calls[-1] == 0


def test_git_source(spark, tmp_path):
    repo = tmp_path / "one"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.c").write_text("int a;\n")
    run("add", ".")
    run("commit", "-qm", "first\n\nbody ")
    (repo / "a.c").write_text("int b;\n")
    run("commit", "-qam", "second")
    (tmp_path / "not_a_repository").mkdir()
    spark.dataSource.register(GitLogSource)
    got = spark.read.format("gitlog").option("root", str(tmp_path)).load().collect()
    assert {(r.repository_name, r.message, r.modified_files_count) for r in got} == {("one", "first\n\nbody", 1), ("one", "second", 1)}
    blobs = spark.read.format("gitlog").option("root", str(tmp_path)).option("blobs", "true").load()
    kinds = {(r.kind, r.content) for r in blobs.where("kind <> 'diff'").collect()}
    assert ("before", "int a;\n") in kinds and ("before", None) in kinds


def test_stream_upsert_is_idempotent(spark):
    base = fresh_path(spark, "stream-test")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(f"{base}/in")
    for check in ("c1", "c2"):  # a lost checkpoint reads everything again
        incremental.stream_upsert(spark, f"{base}/in", df.schema, ["k"], f"{base}/out", f"{base}/{check}").awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 2


def test_slices_and_samples(spark):
    df = spark.createDataFrame([(i,) for i in random.Random(3).sample(range(100), 100)], "k int")
    got = {r.k: r.slice for r in windows.slices(df, ["k"], 40, 2).collect()}
    assert all(got[k] == min(k // 40, 1) for k in range(100))
    q = windows.quota_sample(df, F.col("k") < 10, 5, 20, ["k"], [F.md5(F.col("k").cast("string")), "k"])
    assert q.count() == 20 and q.where("k < 10").count() == 5


def test_nested_metrics_of_nothing(spark):
    df = spark.createDataFrame([(1, {"A": {"x": 1.0}, "N": {"x": 2.0}}), (2, {"A": {"x": 1.0}, "N": {}}), (3, {}), (4, None)], "k int, m map<string,map<string,double>>")
    assert [r.k for r in df.where(perf.has_results(F.col("m"), ["A", "N"])).collect()] == [1]
    assert [r.k for r in df.where(perf.no_results(F.col("m"))).collect()] == [3, 4]
    assert perf.explode_results(df.where("k = 1"), ["k"], "m").count() == 2


def test_inertia_by_hand(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [5.0, 5.0])], "c int, v array<double>")
    assert {r.c: (r["size"], r.inertia) for r in clusters.inertia(df, "c", "v").collect()} == {1: (2, 2.0), 2: (1, 0.0)}


def test_spans_count_every_line_of_a_body_and_pass_over_unclosed_ones():
    body = "int f(int a)\n{\n#define B {\n  x;\n}\n}\nint g(void) {\n  y;\n}\n"
    assert codefn.function_spans(body) == [("f", 1, 6), ("g", 7, 9)]
    unclosed = "static int f(int a) {\n  if (a) {\nint g(void) { return 1; }\n"
    assert codefn.function_spans(unclosed) == []
    feed = "int f(void) {\n  a;\x0c b;  c;\n}\nint g(void) {\n  d;\n}\n"
    assert codefn.function_spans(feed) == [("f", 1, 3), ("g", 4, 6)]
    assert [c[6] for c in codefn.changes(feed, feed.replace("d;", "e;"))] == ["g"]
    # the brackets of a head over several lines must close before its { counts
    assert codefn.function_spans("int f(int a,\n  int b)\n{\n}\n") == [("f", 1, 4)]


def test_changes_have_null_where_nothing_stood():
    (one,) = codefn.changes("a\nb\n", "a\nx\nb\n")
    assert one[1] == "insert" and one[7] is None and one[8] == "x\n"
    (one,) = codefn.changes("a\nx\nb\n", "a\nb\n")
    assert one[1] == "delete" and one[7] == "x\n" and one[8] is None


def test_commit_rows(spark):
    f = "int f(int a) {\n  return a;\n}\n"
    g = "int g(int a) {\n  return a;\n}\n"
    rows = [
        ("one", "a.c", f + g, f.replace("return a", "return a + 1") + g), ("two", "a.c", f + g, f.replace("a;", "b;") + g.replace("a;", "b;")), ("two", "b.c", f, f.replace("a;", "c;")),
        ("new", "a.cc", f, f + g), ("other", "a.c", "int x;\n" + f, "int y;\n" + f), ("python", "a.py", f, g), ("half", "a.c", f, None), (None, "a.h", f, f),
    ]
    df = spark.createDataFrame(rows, "hash string, file_path string, b string, a string")
    got = {r.hash: r for r in codefn.commit_rows(df, ["hash"], "file_path", "b", "a").collect()}
    assert (got["one"].modified_func, got["one"].before_func, got["one"].after_func) == (["f"], f.strip(), f.replace("return a", "return a + 1").strip())
    assert got["two"].modified_func == ["f", "g"] and got["two"].modified_func_count == 2 and got["two"].before_func is None
    assert (got["new"].modified_func, got["new"].before_func, got["new"].after_func) == (["g"], None, g.strip())
    assert got["other"].modified_other and got["other"].modified_func == []
    assert all(got[k].modified_func_count == 0 and not got[k].modified_other for k in ("python", "half"))
    ordered = codefn.modified_functions(codefn.attribute_changes(spark.createDataFrame([(1, g + f, g.replace("a;", "b;") + f.replace("a;", "b;"))], "k int, b string, a string"), ["k"], "b", "a"), ["k"]).first()
    assert ordered.modified_func == ["g", "f"] and ordered.replaces == 2


def test_accents_fold_in_any_script(spark):
    assert one(spark, T.word_tokens(F.col("c")), c="Été Ελλάδα naïve éa Łódź 中文 x") == ["ete", "ελλαδα", "naive", "ea", "łodz", "中文"]
    assert one(spark, T.blank_tokens(F.col("c")), c=" a b\n c ") == ["a", "b", "c"]


def test_log_lines_as_they_are_taken(spark):
    log = "  fillseq : 2.5 micros/op 399000.5 ops/sec 2.5 seconds 1,000 operations; 44.1 MB/s\nreadrandom : 3.0 micros/op 1 ops/sec 2 seconds 3 operations;\n"
    got = {(r.bench, r.metric): r.value for r in perf.parse_db_bench(spark.createDataFrame([("h", log)], "hash string, t string"), "t").collect()}
    assert got[("fillseq", "ops_per_sec")] == 399000.5 and not any(b == "readrandom" for b, _ in got)
    red = "  ====== SET ======\n  9 requests per second of another kind\n  throughput summary: 1.5 requests per second\n  throughput summary: 2.5 requests per second\n  latency summary (msec):\n h\n 1 2 3 4 5 x\n"
    got = {(r.bench, r.metric): r.value for r in perf.parse_redis(spark.createDataFrame([("h", red)], "hash string, t string"), "t").collect()}
    assert got == {("SET", "throughput"): 2.5}


def test_equal_points_stay_apart(spark):
    pts = spark.createDataFrame([(1, 5), (1, 5), (2, 50)], "k int, v int")
    spans = spark.createDataFrame([(0, 10, 1, "low")], "lo int, hi int, o int, name string")
    got = [(r.k, r.name) for r in setjoin.range_first(pts, spans, "v", "lo", "hi", "o", "name", 10).collect()]
    assert sorted(got, key=str) == [(1, "low"), (1, "low"), (2, None)]


def test_one_dendrogram_gives_every_cut():
    rnd = np.random.default_rng(7)
    x = rnd.standard_normal((40, 3))
    merges = clusters.ward_merges(x)
    for k in (1, 2, 5, 39):
        # brute force: join the pair whose union adds least to the sum of squares
        groups = [[i] for i in range(40)]
        while len(groups) > k:
            cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
            _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            groups[i] += groups.pop(j)
        labels = clusters.cut_merges(merges, 40, k)
        assert {frozenset(g) for g in groups} == {frozenset(np.nonzero(labels == c)[0].tolist()) for c in set(labels)}


def test_kmeans_variants(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, (np.eye(3)[i % 3] * 5 + rnd.normal(0, 0.1, 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    got = {r.k: r.cluster for r in clusters.kmeans(df, "v", 3, starts=3).collect()}
    assert len({(i % 3, c) for i, c in got.items()}) == 3
    x = np.array([v for _, v in rows])
    labels = {r.k: r.cluster for r in clusters.minibatch_kmeans(df, "k", "v", 3, batches=4, passes=4).collect()}
    at = np.array([labels[i] for i in range(90)])
    assert sum(((x[at == c] - x[at == c].mean(axis=0)) ** 2).sum() for c in set(at)) < 0.7 * ((x - x.mean(axis=0)) ** 2).sum()
    assert clusters.minibatch_kmeans(df.limit(0), "k", "v", 3).count() == 0


def test_a_model_is_told_what_was_wrong(spark):
    def provider(prompts):
        return ["```a```" if "only one" in p else "```a``` ```b```" for p in prompts]

    df = spark.createDataFrame([(1, "f")], "k int, code string")
    out = completions.run(df, ["k"], completions.TASKS["optimise"], provider).collect()
    assert {r.code for r in out} == {"a"} and all(r.status == "success" for r in out)
    assert completions.one_code_block("none") and completions.one_code_block("```x```") is None
