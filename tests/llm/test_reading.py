import random

import numpy as np

from tarnwork.llm import reading as r

LEVEL = {
    1: ["We like to play with the red ball.", "The cat is on the mat.", "You can put it in the box.", "Do not run in the hall.", "I see a big dog.", "It is fun to sing a song."],
    2: ["Most people find the new station easy to reach by bus.", "A simple habit can save you money every month.", "The longer you wait, the more expensive the ticket becomes.", "There are several good reasons to plan a journey early."],
    3: ["The scheduler reuses an idle connection before it opens another socket.", "Callers must hold the mutex while the index is rebuilt.", "A buffered writer flushes its pages when the queue is full.", "The parser caches tokens, so a second pass skips allocation."],
    4: ["Notwithstanding the foregoing asymptotics, the contrapositive precludes any commensurate relaxation.", "Empirical corroboration substantiates the conjecture that equilibria remain submodular under perturbation.", "We accordingly postulate a heteroscedastic bound whose tightness presupposes ergodicity.", "The ostensible dichotomy dissolves once the functional is recast as a stochastic optimisation."],
}
CODE = ["int f(int a) { return a; }", "for (i = 0; i < n; i++) {", "  sum += x[i];", "}", "#include <a.h>", "return (int)sum;"]
LOG = ["[10:22:01] INFO keys=812 load", "read_random : 12.3 micros/op 44 ops/sec", "fix leak in io/node", "bump lib/x to 2.1", "docs: mention y_limit"]


def passage(level, rnd, n=9):
    mixed = [rnd.choice(LEVEL[level]) for _ in range(n)]
    if rnd.random() < 0.5:
        mixed[rnd.randrange(n)] = rnd.choice(LEVEL[rnd.choice([1, 2, 3, 4])])
    return " ".join(mixed)


def graded(seed=1, n=48):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        level = i % 4 + 1
        rated = level if i % 12 else min(4, level + 1)  # some ratings are one level off
        out.append((passage(level, rnd), rated))
    return out


def frame(spark, seed=2):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(160):
        level = rnd.randrange(1, 5)
        text = passage(level, rnd, 10)
        if rnd.random() < 0.2:
            text = text.upper()
        if rnd.random() < 0.3:
            text = "\n".join(f"* {s}" for s in text.split(". "))
        if rnd.random() < 0.3:
            text += "\n\n```\n" + "\n".join(CODE) + "\n```\n"
        docs.append((i, text, "note", 0))
        truth[i] = level
    for i in range(200, 280):
        docs.append((i, "\n".join(rnd.choice(CODE) for _ in range(20)), "source", 0))
    for i in range(300, 360):
        docs.append((i, "\n".join(rnd.choice(LOG) for _ in range(20)), "log", 0))
    return docs, truth


SCHEMA = "doc_id long, text string, doc_kind string, reading_level int"


def run(spark, docs, items=()):
    df = spark.createDataFrame(docs, SCHEMA)
    g = spark.createDataFrame(graded(), "text string, rated_level int")
    it = spark.createDataFrame(list(items), "item_id long, item_text string")
    return {x.doc_id: x.reading_level for x in r.reading_levels(df, g, it, doc_id="doc_id", text="text", kind="doc_kind").collect()}


def test_levels_of_new_documents(spark):
    docs, truth = frame(spark)
    secret = " ".join(f"word{k} of the item number {k}" for k in range(20))
    docs += docs[:10] + [(900, None, "note", 0), (901, "", "note", 0), (902, "too short a text", "note", 0), (903, "Der Puffer wird nicht mehr kopiert, weil er nur gelesen wird. " * 10, "note", 0), (904, None, None, 0), (905, secret, "note", 0), (906, "I see a big dog. The cat is on the mat. " * 4000, None, 0)]
    got = run(spark, docs, [(1, secret), (2, None)])
    hit = [got.get(i) == level for i, level in truth.items()]
    assert np.mean(hit) > 0.9
    assert not any(i in got for i in [*range(200, 280), *range(300, 360), 900, 901, 902, 903, 904, 905])
    assert got[906] == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    g = spark.createDataFrame([], "text string, rated_level int")
    assert r.reading_levels(df, g, None, doc_id="doc_id", text="text", kind="doc_kind").count() == 0
    docs, _ = frame(spark)
    assert r.reading_levels(spark.createDataFrame(docs, SCHEMA), g, None, doc_id="doc_id", text="text", kind="doc_kind").count() > 0


def test_ordinal_fit_recovers_the_order():
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((2000, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rnd.logistic(size=2000)
    y = np.digitize(z, [-2.0, 0.0, 2.0])
    beta, cuts = r.fit_ordinal(x, np.eye(4)[y])
    assert beta[0] > 1.2 and beta[1] < -0.5 and abs(beta[2]) < 0.3 and (np.diff(cuts) > 0).all()
    p = r.level_probabilities(x @ beta, cuts)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-6)


def test_legal_notices_and_fences_do_not_count():
    notice = "Redistribution is permitted provided that this notice and the warranty disclaimer of the licensor accompany every derivative."
    assert r.is_legal(notice) and not r.is_legal("The notice on the door says when the shop is open and when it is not.")
    assert r.lines_of("# Title\n\n```\ncode here\n```\ntext") == ["text"]


def test_a_line_is_judged_by_all_its_words():
    """A long line that opens unlike it goes on: the part beyond its first tokens decides."""
    rnd = random.Random(6)
    docs = [(passage(k % 4 + 1, rnd), True) for k in range(80)] + [("\n".join(rnd.choice(CODE + LOG) for _ in range(20)), False) for _ in range(80)]
    weights, rarity = r.fit_lines(docs), np.zeros(r.RARITY_BUCKETS)
    rarity[0] = 9.0
    code, prose = " ".join(CODE * 2), passage(3, random.Random(7))
    late = code + " " + " ".join([prose] * 6)
    early = " ".join([prose] * 1) + " " + " ".join(CODE * 12)
    assert len(r._SHAPE.findall(code)) > 60 and len(r._SHAPE.findall(prose)) > 60
    assert len(r.prose_of(late, weights, rarity)[0]) == 1
    assert r.prose_of(early, weights, rarity)[0] == []
    assert r.line_slots(late) != r.line_slots(late[: len(late) // 2])


def test_a_batch_equals_its_texts_one_by_one():
    """The arrays of a batch say what plain loops over one text say: lines, their scores, stretches and features."""
    rnd = random.Random(8)
    mixed = ["It’s the user's `x` value, see lib/a.c: read_all it. And so; because the\tlist (of 12) grew, we stop!", "naïve ünder 中文 words ok.", "- Call foo_bar now. Then wait", "## head", "===", "see https://a.b/c and [t](u) here", ""]
    texts = ["\n".join(rnd.choice(mixed + LEVEL[3] + CODE) for _ in range(30)) for _ in range(12)]
    docs = [(passage(k % 4 + 1, rnd), True) for k in range(60)] + [("\n".join(rnd.choice(CODE + LOG) for _ in range(20)), False) for _ in range(60)]
    rarity = np.random.default_rng(2).random(r.RARITY_BUCKETS)
    model = r.train(graded(), rarity, r.fit_lines(docs))
    reader = r.Reader(model)
    kept, _, (ids, line, owner) = reader.prose(texts)
    raw = [x for t in texts for x in r.plain_lines(t).split("\n")]
    scores = r.line_sums(reader.known, ids, line, len(raw), model.lines)
    for k, x in enumerate(raw):
        slots = r.line_slots(r._NAME_WORD.sub(" ` ", x))
        want = model.lines[slots].sum() / np.sqrt(max(1, len(slots))) + model.lines[-1]
        assert abs(scores[k] - want) < 1e-9
    use = kept[line] & reader.known.flag["word"][ids]
    stop = np.concatenate([[0], np.cumsum(reader.known.flag["stop"][ids[:-1]] | (line[1:] != line[:-1]))])
    first = reader.cut(ids[use], stop[use], owner[use])
    got = reader.features(ids[use], first)
    at, want = 0, []
    for t in texts:
        lines = [r._NAME_WORD.sub(" ` ", x) for x in r.plain_lines(t).split("\n")]
        mine = [x for k, x in enumerate(lines) if kept[at + k]]
        at += len(lines)
        want += [r.features(ws, rarity, model.graded, model.unseen) for ws in r.stretches(mine)]
    assert kept.any() and got.shape == np.array(want).shape and np.allclose(got, np.array(want))
    model_finder = None
    whole = reader.levels(texts + [None, ""], model_finder)
    assert whole == [r.Reader(model).levels([t], None)[0] for t in texts + [None, ""]]


def test_typographic_apostrophes_and_repeats_do_not_make_words_rare(spark):
    docs = spark.createDataFrame([(1, "it’s fine"), (1, "it’s fine"), (2, "it's late"), (3, None), (None, "it's")], "doc_id long, text string")
    table = r.rarity_table(docs, "doc_id", "text")
    import zlib

    n = (4 + 1) / np.exp(table[[zlib.crc32(w.encode()) % r.RARITY_BUCKETS for w in ("it's", "fine")]])
    assert np.allclose(n, [3, 1])


def test_items_in_several_blocks(spark, monkeypatch):
    import tarnwork.llm.leakage as m

    docs, _ = frame(spark)
    secret = [(k, " ".join(f"word{j}x{k} of the item number {j}" for j in range(20))) for k in range(1, 4)]
    docs += [(900 + k, t, "note", 0) for k, t in secret]
    one = run(spark, docs, secret)
    monkeypatch.setattr(m, "BLOCK_WORDS", 100)
    assert run(spark, docs, secret) == one and not any(900 + k in one for k, _ in secret)
