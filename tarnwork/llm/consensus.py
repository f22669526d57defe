"""Consensus of several annotators' labels: a mixture of competence and spamming, fitted by expectation-maximisation.

A rater gives the true label with a probability of their own (their competence) and otherwise draws a label from a guess
distribution of their own. Items with equal votes have equal posteriors, so the E-step runs over the
distinct vote patterns with their counts; partial sums per rater leave each partition, and only two numbers a rater
reach the driver. Kinds of item (``origin``) have raters and a prior of their own and are fitted at once.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.staging import stage

MAX_CYCLES = 40
TOLERANCE = 1e-4
#: Raters whose parameters are broadcast (some 50 bytes each); more are refused, not dropped.
MAX_RATERS = 1_000_000
# Pseudo-counts of competence and of the guesses.
COMPETENCE_PRIOR, GUESS_PRIOR = 0.5, 0.5


@dataclass
class Raters:
    origin: np.ndarray
    rater: np.ndarray
    competence: np.ndarray
    guess: np.ndarray  # probability that a guess is "true"
    votes: np.ndarray
    prior: dict[str, float]

    def log_ratio(self) -> tuple[np.ndarray, np.ndarray]:
        """log P(label | true item) - log P(label | false item) of a rater's "false" and "true" votes."""
        t, x = self.competence, self.guess
        say_true = np.log(t + (1 - t) * x) - np.log((1 - t) * x)
        say_false = np.log((1 - t) * (1 - x)) - np.log(t + (1 - t) * (1 - x))
        return say_false, say_true


def clean_rater(name: Column) -> Column:
    """Case and outer blanks make no difference."""
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def vote_patterns(votes: DataFrame, raters: DataFrame) -> DataFrame:
    """(origin, record_id, pattern) with the pattern an ordered array of (code, n), code = 2 * rater index + label.

    Votes are counted per item, rater and label before they are gathered, so that an item with any number of votes is
    an array of at most two entries a rater.
    """
    coded = votes.join(F.broadcast(raters), ["origin", "rater"]).withColumn("code", F.col("idx") * 2 + F.col("label").cast("int"))
    counts = coded.groupBy("origin", "record_id", "code").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.groupBy("origin", "record_id").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("pattern"))


def _flat(patterns: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, votes) of the entries of all patterns, from the arrays they lie in."""
    size = pc.fill_null(pc.list_value_length(patterns), 0).to_numpy(zero_copy_only=False).astype("int64")
    entries = patterns.flatten()
    return np.repeat(np.arange(len(patterns)), size), entries.field("code").to_numpy(zero_copy_only=False).astype("int64"), entries.field("n").to_numpy(zero_copy_only=False).astype("float64")


def _by_origin(origin: np.ndarray, values: dict[str, float]) -> np.ndarray:
    kind, names = pd.factorize(origin)
    return np.array([values[o] for o in names], dtype="float64")[kind]


def posterior(origin: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray, raters: Raters) -> np.ndarray:
    say_false, say_true = raters.log_ratio()
    each = np.where(code % 2 == 1, say_true[code // 2], say_false[code // 2]) * n
    prior = _logit(_by_origin(origin, raters.prior))
    return 1 / (1 + np.exp(-np.clip(prior + np.bincount(row, each, len(origin)), -500, 500)))


def expectations(origin: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray, items: np.ndarray, raters: Raters, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, and expected votes that were guesses: all, and those for "true", by rater."""
    if first:  # the share of true votes
        share = np.bincount(row, n * (code % 2), len(origin)) / np.bincount(row, n, len(origin))
        q = share
    else:
        q = posterior(origin, row, code, n, raters)
    r, label = code // 2, code % 2
    t, x = raters.competence[r], np.where(label == 1, raters.guess[r], 1 - raters.guess[r])
    agrees = np.where(label == 1, q[row], 1 - q[row])
    guess_if_agrees = (1 - t) * x / (t + (1 - t) * x)
    spam = agrees * guess_if_agrees + (1 - agrees)
    weight = n * items[row] * spam
    size = len(raters.competence)
    return q, np.bincount(r, weight, size), np.bincount(r, weight * label, size)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def _vector(m: Raters) -> np.ndarray:
    return np.concatenate([_logit(m.competence), _logit(m.guess), _logit(np.array(list(m.prior.values())))])


def _model(v: np.ndarray, like: Raters) -> Raters:
    p = 1 / (1 + np.exp(-np.clip(v, -13, 13)))
    n = len(like.competence)
    return Raters(like.origin, like.rater, p[:n], p[n : 2 * n], like.votes, dict(zip(like.prior, p[2 * n :].tolist())))


def _step(patterns: DataFrame, now: Raters, first: bool) -> tuple[Raters, float]:
    """The model after one E- and M-step, and the log-likelihood of the given one."""
    size = len(now.competence)
    given = patterns.sparkSession.sparkContext.broadcast((now, first))

    def e_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, start = given.value
        guesses, of_true = np.zeros(len(model.competence)), np.zeros(len(model.competence))
        t, x = model.competence, model.guess
        if_false = np.stack([np.log(t + (1 - t) * (1 - x)), np.log((1 - t) * x)], axis=1)  # of "false" and "true" votes
        true_items: dict[str, list[float]] = {}
        likelihood = 0.0
        for batch in batches:
            row, code, n = _flat(batch.column(batch.schema.get_field_index("pattern")))
            o, items = batch.column(batch.schema.get_field_index("origin")).to_numpy(zero_copy_only=False), batch.column(batch.schema.get_field_index("items")).to_numpy().astype("float64")
            q, g, gt = expectations(o, row, code, n, items, model, start)
            guesses += g
            of_true += gt
            prior = _by_origin(o, model.prior)
            p = np.clip(q if not start else posterior(o, row, code, n, model), 1e-300, 1 - 1e-12)
            likelihood += float((items * (np.log1p(-prior) + np.bincount(row, if_false[code // 2, code % 2] * n, len(o)) - np.log1p(-p))).sum())
            kind, names = pd.factorize(o)
            for k, one in enumerate(names):
                was = true_items.setdefault(one, [0.0, 0.0])
                was[0] += float((q * items)[kind == k].sum())
                was[1] += float(items[kind == k].sum())
        used = np.nonzero(guesses)[0]
        keys = [*(f"r{k}" for k in used), *(f"o{k}" for k in true_items), "l"]
        yield pa.RecordBatch.from_pydict({"key": keys, "a": [*guesses[used], *(v[0] for v in true_items.values()), likelihood], "b": [*of_true[used], *(v[1] for v in true_items.values()), 0.0]})

    sums = patterns.mapInArrow(e_step, "key string, a double, b double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    given.unpersist()
    guesses, of_true, prior, likelihood = np.zeros(size), np.zeros(size), dict(now.prior), 0.0
    for key, a, b in zip(sums.key, sums.a, sums.b):
        if key == "l":
            likelihood = a
        elif key[0] == "o":
            prior[key[1:]] = min(max(a / b, 1e-3), 1 - 1e-3)
        else:
            guesses[int(key[1:])], of_true[int(key[1:])] = a, b
    competence = (now.votes - guesses + COMPETENCE_PRIOR) / (now.votes + 2 * COMPETENCE_PRIOR)
    guess = (of_true + GUESS_PRIOR) / (guesses + 2 * GUESS_PRIOR)
    return Raters(now.origin, now.rater, np.clip(competence, 1e-6, 1 - 1e-6), np.clip(guess, 1e-6, 1 - 1e-6), now.votes, prior), likelihood


def fit(patterns: DataFrame, raters: pd.DataFrame) -> Raters:
    """``patterns``: origin, pattern, items. Raters are indexed as in ``raters`` (origin, rater, votes).

    Plain steps creep; two steps tell the direction and a squared extrapolation goes along it as far as the likelihood
    does not fall.
    """
    size = len(raters)
    start = Raters(raters.origin.to_numpy(), raters.rater.to_numpy(), np.full(size, 0.7), np.full(size, 0.5), raters.votes.to_numpy(dtype="float64"), {o: 0.5 for o in sorted(set(raters.origin))})
    now, _ = _step(patterns, start, True)
    safe, best = now, -np.inf  # what to go back to if an extrapolation was too bold
    for _ in range(MAX_CYCLES):
        one, likelihood = _step(patterns, now, False)
        if likelihood < best - 1e-6 * abs(best):
            now = safe
            one, likelihood = _step(patterns, now, False)
        best = max(best, likelihood)
        two, _ = _step(patterns, one, False)
        safe = two
        x0, x1, x2 = _vector(now), _vector(one), _vector(two)
        r, v = x1 - x0, x2 - 2 * x1 + x0
        sure = np.concatenate([np.abs(one.competence - now.competence), np.abs(one.guess - now.guess)]).max(initial=0)
        if sure < TOLERANCE:
            return two
        length = min(max(np.linalg.norm(r) / max(np.linalg.norm(v), 1e-12), 1.0), 50.0)
        now = _model(x0 + 2 * length * r + length**2 * v, two)
    warnings.warn(f"no convergence in {MAX_CYCLES} cycles: a rater's parameters still move by {sure:.1e}", stacklevel=2)
    return safe


def _prepared(votes: DataFrame) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    once = votes.where("label IS NOT NULL AND rater IS NOT NULL AND record_id IS NOT NULL").groupBy("origin", "record_id", "vote_id", "rater").agg(F.max("label").alias("label")).drop("vote_id")
    once = stage(once, "votes")
    counted = once.groupBy("origin", "rater").agg(F.count(F.lit(1)).alias("votes"))
    known = counted.orderBy("origin", "rater").limit(MAX_RATERS + 1).toPandas()
    if len(known) > MAX_RATERS:
        raise ValueError(f"more than {MAX_RATERS} raters")
    indexed = votes.sparkSession.createDataFrame([(o, r, i) for i, (o, r) in enumerate(zip(known.origin, known.rater))], "origin string, rater string, idx long")
    return once, stage(vote_patterns(once, indexed), "vote_patterns"), known


def consensus(votes: DataFrame) -> tuple[DataFrame, Raters]:
    """Items and raters of ``votes`` (origin, record_id, vote_id, rater, label).

    Items: origin, record_id, consensus, probability, n_votes, agreement (share of votes equal to the consensus). Null
    votes, raters and ids are no votes; an item without votes has no row; a vote delivered again (same vote_id) counts once;
    an item at exactly even odds is false; no votes at all give empty results. Extra columns are ignored.
    """
    spark = votes.sparkSession
    _, patterns, known = _prepared(votes)
    grouped = stage(patterns.groupBy("origin", "pattern").agg(F.count(F.lit(1)).alias("items")), "pattern_counts")
    if known.empty:
        model = Raters(*[np.array([])] * 5, {})
    else:
        model = fit(grouped, known)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, record, pattern = (batch.column(batch.schema.get_field_index(c)) for c in ("origin", "record_id", "pattern"))
            row, code, n = _flat(pattern)
            p = posterior(origin.to_numpy(zero_copy_only=False), row, code, n, shared.value)
            total, true = np.bincount(row, n, len(p)), np.bincount(row, n * (code % 2), len(p))
            yield pa.RecordBatch.from_arrays([origin, record, pa.array(p), pa.array(total.astype("int32")), pa.array(true.astype("int32"))], names=["origin", "record_id", "probability", "n_votes", "n_true"])

    judged = patterns.select("origin", "record_id", "pattern").mapInArrow(judge, "origin string, record_id long, probability double, n_votes int, n_true int")
    total, true = F.col("n_votes"), F.col("n_true")
    items = judged.select(
        "origin", "record_id", (F.col("probability") > 0.5).alias("consensus"), F.round("probability", 6).alias("probability"), "n_votes",
        F.round(F.when(F.col("probability") > 0.5, true).otherwise(total - true) / total, 6).alias("agreement"),
    )
    return items, model


def rater_table(votes: DataFrame) -> DataFrame:
    """(origin, rater, n_votes, competence, guesses_true, accuracy): accuracy is the share of votes equal to the consensus."""
    items, model = consensus(votes)
    spark = votes.sparkSession
    once = votes.where("label IS NOT NULL AND rater IS NOT NULL").groupBy("origin", "record_id", "vote_id", "rater").agg(F.max("label").alias("label"))
    right = once.join(items.select("origin", "record_id", "consensus"), ["origin", "record_id"]).groupBy("origin", "rater").agg(F.round(F.avg((F.col("label") == F.col("consensus")).cast("int")), 6).alias("accuracy"))
    rows = [(str(o), str(r), int(n), round(float(c), 6), round(float(g), 6)) for o, r, n, c, g in zip(model.origin, model.rater, model.votes, model.competence, model.guess)]
    return spark.createDataFrame(rows, "origin string, rater string, n_votes long, competence double, guesses_true double").join(right, ["origin", "rater"])


def agreement_table(votes: DataFrame) -> DataFrame:
    """(origin, n_items, n_votes, alpha): Krippendorff's alpha of the labels; null where it is not defined."""
    once = votes.where("label IS NOT NULL AND record_id IS NOT NULL").groupBy("origin", "record_id", "vote_id").agg(F.max("label").alias("label"))
    per = once.groupBy("origin", "record_id").agg(F.count(F.lit(1)).alias("m"), F.count_if("label").alias("t")).where("m > 1")
    sums = per.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_votes"), F.sum("t").alias("t"),
        F.sum(2 * F.col("t") * (F.col("m") - F.col("t")) / (F.col("m") - 1)).alias("observed"),
    )
    n, t = F.col("n_votes"), F.col("t")
    expected = 2 * t * (n - t) / (n - 1)
    return sums.select("origin", "n_items", "n_votes", F.round(F.when(expected > 0, 1 - F.col("observed") / expected), 6).alias("alpha"))
