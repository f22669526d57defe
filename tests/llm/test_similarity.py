import random

import numpy as np

from tarnwork.llm import similarity as s

IDEAS = [
    (["hoisting the strlen call", "computing the length once", "moving the bound out of the loop"], ["to save a call per round", "to avoid rescanning text"]),
    (["striping the lock by key", "splitting one mutex into shards", "giving each bucket its own lock"], ["to spread contention", "to stop waiting threads"]),
    (["reserving capacity up front", "presizing the container", "allocating the final size ahead"], ["to avoid growth steps", "to skip reallocation"]),
    (["inlining the tiny helper", "marking the accessor inline", "moving the body into the header"], ["to drop call overhead", "to open it to the optimiser"]),
]
FRAMES = ["The change works by {} in `{}`.", "What made it faster is {}; see `{}`.", "Performance was raised by {} ({}).", "This commit speeds up `{1}` through {0}."]


def commits(n, seed=1):
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        idea = r.randrange(len(IDEAS))
        say = lambda: r.choice(FRAMES).format(r.choice(IDEAS[idea][0]) + r.choice(["", " " + r.choice(IDEAS[idea][1])]), f"name_{r.randrange(999)}")
        rows.append((i, say(), [say() for _ in range(4)], 0))
        truth[i] = idea
    for i in range(n, n + 40):
        t = f"Garbage left by `x_{i}` in the folder is swept at {i} second intervals."
        rows.append((i, t, [t] * 4, 0))
    return rows, truth


def frames(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, text string, texts array<string>, part int")
    return df.select("record_id", "text", "part"), df.select("record_id", "texts", "part")


def test_ideas_in_other_words_are_one_group(spark):
    rows, truth = commits(400)
    rows += rows[:30] + [(9000, None, None, 0), (9001, "", [], 0), (9002, "zzz qqq", ["zzz qqq"], 0), (9003, "word " * 50_000, [None], 0)]
    got = {r.record_id: r for r in s.assign(*frames(spark, rows)).collect()}
    assert len(got) == 444
    pairs = right = 0
    ids = sorted(truth)
    for a in ids[::7]:
        for b in ids[::5]:
            if a < b:
                pairs += 1
                same = got[a].cluster_id == got[b].cluster_id and got[a].recurring and got[b].recurring
                right += same == (truth[a] == truth[b])
    assert right / pairs > 0.97
    assert not any(got[i].recurring for i in range(400, 440))
    assert all(got[i].cluster_id is None for i in (9000, 9001, 9002))


def test_table_of_groups(spark):
    rows, _ = commits(200, 2)
    placed = s.assign(*frames(spark, rows))
    table = s.cluster_table(placed).collect()
    assert sum(r["size"] for r in table) == placed.where("cluster_id IS NOT NULL").count()
    assert all(1 <= len(r.typical) <= s.TYPICAL for r in table)


def test_nothing_to_group(spark):
    assert s.assign(*frames(spark, [])).count() == 0
    assert [r.cluster_id for r in s.assign(*frames(spark, [(1, "a b", ["a b"], 0)])).collect()] == [None]


def test_features_of_a_tree_add_up():
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(c, 0.02, (200, 3)) for c in np.eye(3)])
    tree = s.CFTree()
    for v in rnd.permutation(x):
        tree.add(1.0, v, float(v @ v))
    e = tree.entries()
    assert sum(n for n, _, _ in e) == len(x)
    assert np.allclose(sum(ls for _, ls, _ in e), x.sum(axis=0)) and np.isclose(sum(ss for _, _, ss in e), (x**2).sum())
    assert all(ss / n - (ls @ ls) / n**2 <= tree.radius2 + 1e-9 for n, ls, ss in e)
    assert len(s.ward(e)) == 3
    small = s.CFTree(radius2=1e-9, most=20)
    for v in x:
        small.add(1.0, v, float(v @ v))
    assert small.size <= 20 and sum(n for n, _, _ in small.entries()) == len(x)


def test_leading_eigenvectors():
    rnd = np.random.default_rng(2)
    q = np.linalg.qr(rnd.standard_normal((400, 400)))[0]
    m = (q * np.concatenate([np.linspace(50, 10, 12), np.linspace(1, 0, 388)])) @ q.T
    values, vectors = s.leading(m, 10)
    assert np.allclose(sorted(values), sorted(np.linalg.eigvalsh(m)[-10:]), atol=1e-6)
    assert np.allclose(m @ vectors, vectors * values, atol=1e-4)


def test_no_term_is_dropped_for_its_rank_or_the_size_of_the_table(spark):
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(3400)]
    texts = [[" ".join(words[k : k + 20])] * 2 for k in range(0, 3400, 20)]
    few = spark.createDataFrame([(x,) for x in texts * 5], "texts array<string>")
    assert set(words) <= set(s.vocabulary(few))
    assert set(s.vocabulary(spark.createDataFrame([(x,) for x in texts[:2] * 5 + [["only here"]] * 20_000], "texts array<string>"))) >= set(words[:40])
    assert s.vocabulary(spark.createDataFrame([(x,) for x in texts[:2] * 4], "texts array<string>")) == []


def test_company_in_strips_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(s, "STRIP_CELLS", 1)
    monkeypatch.setattr(s, "HELD_TERMS", 1000)
    r = random.Random(4)
    vocab = ["".join(chr(97 + k // 26**j % 26) for j in range(2)) for k in range(330)]
    rows = [[" ".join(r.sample(vocab, 6)) for _ in range(r.randrange(1, 4))] for _ in range(200)]
    want = np.zeros((330, 330))
    for texts in rows:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if a != b:
                    for x in texts[a].split():
                        for y in texts[b].split():
                            want[vocab.index(x), vocab.index(y)] += 1
    c = s.company(spark.createDataFrame([(x,) for x in rows], "texts array<string>"), vocab)
    assert np.array_equal(c @ np.eye(330), want)


def test_company_is_the_same_in_one_strip_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(s, "COUNTED", 7)
    monkeypatch.setattr(s, "HELD_RECORDS", 5)
    r = random.Random(5)
    vocab = ["".join(chr(97 + k // 26**j % 26) for j in range(2)) for k in range(230)]
    rows = [[" ".join(r.sample(vocab, 9)) for _ in range(r.randrange(1, 4))] for _ in range(150)]
    want = np.zeros((230, 230))
    for texts in rows:
        n = np.array([[float(v in t.split()) for v in vocab] for t in texts])
        want += np.outer(n.sum(axis=0), n.sum(axis=0)) - n.T @ n
    c = s.company(spark.createDataFrame([(x,) for x in rows], "texts array<string>").repartition(20), vocab)
    assert np.array_equal(c @ np.eye(230), want)
    assert np.array_equal(c.sums(), want.sum(axis=1)) and np.array_equal(c.sums(diagonal=False), (want - np.diag(np.diag(want))).sum(axis=1))


def test_copies_of_one_text_do_not_make_an_idea_boilerplate(spark):
    rows, truth = commits(400, 3)
    first = next(i for i, idea in truth.items() if idea == 0)
    text = rows[first][1]
    rows += [(10_000 + k, text, [text], 0) for k in range(800)]
    placed = s.assign(*frames(spark, rows))
    got = {r.record_id: r for r in placed.collect()}
    mine = [got[i] for i, idea in truth.items() if idea == 0]
    assert np.mean([r.recurring and r.cluster_id == got[first].cluster_id for r in mine]) > 0.9
    assert all(got[10_000 + k].recurring for k in range(800)) and not any(got[i].recurring for i in range(400, 440))
    assert max(r["size"] for r in s.cluster_table(placed).collect()) >= 800
