import random

import numpy as np
import pytest

from tarnwork.llm import consensus as c

SCHEMA = "origin string, record_id long, vote_id long, rater string, label boolean, idx int, pattern string"


RATERS = {"good": (0.95, 0.5), "fair": (0.8, 0.5), "yes": (0.05, 0.95), "coin": (0.02, 0.5), "coin2": (0.02, 0.4)}


def simulate(seed=1, items=400):
    r = random.Random(seed)
    raters = RATERS
    truth, votes, v = {}, [], 0
    for i in range(items):
        truth[i] = r.random() < 0.4
        for name, (competence, guess) in raters.items():
            if r.random() < 0.85:
                label = truth[i] if r.random() < competence else r.random() < guess
                votes.append(("a", i, v, name, label, 0, "x"))
                v += 1
    return truth, votes


def brute(votes, steps=600):
    """The same model, vote by vote, without patterns."""
    raters = sorted({x[3] for x in votes})
    n = {r: sum(1 for x in votes if x[3] == r) for r in raters}
    t, g, pi = dict.fromkeys(raters, 0.7), dict.fromkeys(raters, 0.5), 0.5
    items = sorted({x[1] for x in votes})
    by = {i: [x for x in votes if x[1] == i] for i in items}
    q = {i: np.mean([x[4] for x in by[i]]) for i in items}
    for step in range(steps):
        if step:
            q = post(by, t, g, pi)
        guesses, of_true = dict.fromkeys(raters, 0.0), dict.fromkeys(raters, 0.0)
        for i in items:
            for x in by[i]:
                p = g[x[3]] if x[4] else 1 - g[x[3]]
                agrees = q[i] if x[4] else 1 - q[i]
                s = agrees * (1 - t[x[3]]) * p / (t[x[3]] + (1 - t[x[3]]) * p) + 1 - agrees
                guesses[x[3]] += s
                of_true[x[3]] += s * x[4]
        pi = np.mean(list(q.values()))
        new = {r: (n[r] - guesses[r] + 0.5) / (n[r] + 1) for r in raters}
        ng = {r: (of_true[r] + 0.5) / (guesses[r] + 1) for r in raters}
        moved = max(max(abs(new[r] - t[r]), abs(ng[r] - g[r])) for r in raters)
        t, g = new, ng
        if moved < 1e-6:
            break
    return post(by, t, g, pi)


def post(by, t, g, pi):
    out = {}
    for i, xs in by.items():
        z = np.log(pi / (1 - pi))
        for x in xs:
            tr, gr = t[x[3]], g[x[3]]
            z += np.log((tr + (1 - tr) * gr) / ((1 - tr) * gr)) if x[4] else np.log((1 - tr) * (1 - gr) / (tr + (1 - tr) * (1 - gr)))
        out[i] = 1 / (1 + np.exp(-z))
    return out


def test_equals_brute_force_and_beats_the_majority(spark):
    truth, votes = simulate()
    df = spark.createDataFrame(votes + votes[:100], SCHEMA)
    items, model = c.consensus(df)
    got = {r.record_id: r for r in items.collect()}
    want = brute(votes)
    assert all(got[i].probability == pytest.approx(want[i], abs=0.02) for i in want)
    right = np.mean([got[i].consensus == truth[i] for i in got])
    share = {i: np.mean([v[4] for v in votes if v[1] == i]) for i in got}
    # what the true parameters would give is the most that can be had
    by = {i: [v for v in votes if v[1] == i] for i in got}
    best = post(by, {k: v[0] for k, v in RATERS.items()}, {k: v[1] for k, v in RATERS.items()}, 0.4)
    assert right >= np.mean([(best[i] > 0.5) == truth[i] for i in got]) - 0.02
    assert right > np.mean([(share[i] > 0.5) == truth[i] for i in got])
    order = [r for _, r in sorted(zip(model.competence, model.rater), reverse=True)]
    assert order[:2] == ["good", "fair"]
    assert got[0].n_votes == sum(1 for v in votes if v[1] == 0)


def test_nulls_repeats_and_empty(spark):
    rows = [("a", 1, 1, "r", True, 0, ""), ("a", 1, 1, "r", True, 0, ""), ("a", 2, 2, "r", None, 0, ""), ("a", 3, 3, None, True, 0, ""), ("b", 1, 4, "r", False, 0, "")]
    items, _ = c.consensus(spark.createDataFrame(rows, SCHEMA))
    got = {(r.origin, r.record_id): (r.consensus, r.n_votes) for r in items.collect()}
    assert got == {("a", 1): (True, 1), ("b", 1): (False, 1)}
    assert c.consensus(spark.createDataFrame([], SCHEMA))[0].count() == 0
    assert c.rater_table(spark.createDataFrame(rows, SCHEMA)).count() == 2


def test_rater_names(spark):
    df = spark.createDataFrame([(" Rater_1\t",), ("rater_1",)], "n string")
    from pyspark.sql import functions as F

    assert df.select(c.clean_rater(F.col("n")).alias("n")).distinct().count() == 1


def test_alpha_by_hand(spark):
    rows = [("a", 1, 1, "r", True, 0, ""), ("a", 1, 2, "s", True, 0, ""), ("a", 2, 3, "r", True, 0, ""), ("a", 2, 4, "s", False, 0, "")]
    got = c.agreement_table(spark.createDataFrame(rows, SCHEMA)).first()
    # observed disagreement 2 of 4 coded values; expected 2 * 3 * 1 / 3
    assert got.alpha == pytest.approx(1 - 2 / 2)
