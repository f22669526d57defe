"""Stages of the pipeline made of completions, votes and central answers. Each takes a way to ask (``Ask``): calls or stored answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.config import DEFAULTS
from tarnwork.functions import text as T
from tarnwork.functions.vectors import cosine, embed
from tarnwork.operators import completions, votes
from tarnwork.operators.completions import TASKS, Task
from tarnwork.staging import stage

#: (rows, keys, task, done rows or None) -> (keys, attempt, status, parsed columns)
Ask = Callable[[DataFrame, list[str], Task, DataFrame | None], DataFrame]


def calling(provider: completions.Provider = completions.stub_provider) -> Ask:
    """Ask by calls, which are written once so that no later step repeats them."""

    def ask(df: DataFrame, keys: list[str], task: Task, done: DataFrame | None = None) -> DataFrame:
        return stage(completions.run(df, keys, task, provider, done), "answers").drop("request_id", "completion")

    return ask


def replaying(stored: dict[str, DataFrame]) -> Ask:
    """Ask stored answers {task: (keys, attempt, content)}."""

    def ask(df: DataFrame, keys: list[str], task: Task, done: DataFrame | None = None) -> DataFrame:
        out = completions.replay(df, stored[task.name], keys, task)
        return out if done is None else out.join(done.select(*keys, "attempt"), [*keys, "attempt"], "left_anti")

    return ask


def sentences_task(n: int) -> Task:
    """A summary in so many sentences, asked for once."""
    return Task(f"summarise_in_{n}", f"Summarise in {n} sentence{'s' if n > 1 else ''} how this commit makes the code faster. Lines: Summary:, Generic:.\n{{message}}\n{{diff}}", completions._summary)


#: A summary on the level of ideas, without what is special to the code.
GENERAL_SUMMARY = Task("summarise_idea", "Name the idea, not the code, by which this commit makes the code faster. Lines: Summary:, Generic:.\n{message}\n{diff}", completions._summary, attempts=DEFAULTS.summary_attempts)
VERIFY = Task("verify", "Does the new code do the same, and does it use the strategy? Answer as JSON with is_valid and uses_strategy.\n{strategy}\n{code}\n{new_code}", lambda c: dict(_flags(c)))
EXAMPLE_PAIRS = Task("cluster_examples", "Give pairs of code before and after as a JSON array.\n{summaries}", lambda c: {"pairs": T.code_pairs(c)}, attempts=DEFAULTS.summary_attempts)
CONDITIONS = Task("cluster_conditions", "List when the strategy applies.\n{summaries}", lambda c: {"conditions": T.conditions(c)}, attempts=DEFAULTS.summary_attempts)


def _flags(c: Column) -> list[tuple[str, Column]]:
    got = F.from_json(F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit("")), c), "is_valid boolean, uses_strategy boolean")
    return [(n, F.coalesce(got[n], F.lit(False))) for n in ("is_valid", "uses_strategy")]


def top_up(df: DataFrame, keys: list[str], ask: Ask, stored: DataFrame | None = None, task: Task = TASKS["summarise_commit"]) -> DataFrame:
    """(keys, attempt, summary, generic) of every attempt: stored ones, and answers to those that are missing. Failed ones are left out."""
    new = ask(df, keys, task, stored).where("status = 'success'").select(*keys, "attempt", "summary", "generic")
    return new if stored is None else stored.select(*new.columns).unionByName(new)


def central_attempt(answers: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, attempt): the answer most like the others of its key, the first of equal ones; a null text counts as an empty one."""
    v = stage(embed(answers.select(F.struct(*keys).alias("_k"), "attempt", text), text, "_v").select("_k", "attempt", "_v"), "answer_vectors")
    return votes.medoid(v, "_k", "attempt", "_v").select(*[F.col(f"_k.{k}").alias(k) for k in keys], "attempt")


def summarise(df: DataFrame, keys: list[str], ask: Ask, stored: DataFrame | None = None, task: Task = TASKS["summarise_commit"], strict: bool = False) -> DataFrame:
    """(keys, summary, generic, n): the central summary and the vote on generic (by strict majority, or ties to the first)."""
    every = top_up(df, keys, ask, stored, task)
    summary = every.join(central_attempt(every, keys, "summary"), [*keys, "attempt"]).select(*keys, "summary")
    generic = votes.strict_majority(every, keys, "generic").withColumnRenamed("passed", "generic") if strict else votes.majority_vote(every, keys, "generic", "attempt").select(*keys, F.col("winner").alias("generic"))
    return summary.join(generic, keys, "left").join(every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def summarise_until_agreed(df: DataFrame, keys: list[str], ask: Ask, threshold: float = DEFAULTS.agreement_threshold, most: int = 5, task: Task = TASKS["summarise_commit"]) -> DataFrame:
    """As ``summarise``, with one more attempt for those rows of which no two summaries agree by ``threshold``, up to ``most``."""
    every, still = None, df
    for n in range(2, most + 1):
        one = Task(task.name, task.template, task.parse, attempts=n, retries=task.retries, correct=task.correct)
        asked = ask(still, keys, one, every).where("status = 'success'").select(*keys, "attempt", "summary", "generic")
        every = stage(asked if every is None else every.unionByName(asked), "summaries")
        v = embed(every, "summary", "_v")
        a, b = v.select(*keys, F.col("attempt").alias("_a"), F.col("_v").alias("_x")), v.select(*keys, F.col("attempt").alias("_b"), F.col("_v").alias("_y"))
        agreed = a.join(b, keys).where((F.col("_a") < F.col("_b")) & (cosine(F.col("_x"), F.col("_y")) >= threshold)).select(*keys).distinct()
        still = stage(df.join(agreed, keys, "left_anti"), "still_open")
        if still.isEmpty():
            break
    return summarise(df.limit(0), keys, lambda d, k, t, s: ask(d, k, t, None), every, task, strict=True)


def summarise_clusters(df: DataFrame, key: str, ask: Ask) -> DataFrame:
    """(key, strategy, pairs, conditions): three answers an attempt, of which those of one attempt are taken together, that of the central summary."""
    first = ask(df, [key], TASKS["summarise_cluster"], None).where("status = 'success'").select(key, "attempt", "strategy")
    rest = [ask(df, [key], t, None).select(key, "attempt", c) for t, c in ((EXAMPLE_PAIRS, "pairs"), (CONDITIONS, "conditions"))]
    out = first.join(central_attempt(first, [key], "strategy"), [key, "attempt"])
    for r in rest:
        out = out.join(r, [key, "attempt"], "left")
    return out.drop("attempt")


def applies_verified(df: DataFrame, keys: list[str], ask: Ask, task: Task = TASKS["strategy_applies_verified"]) -> DataFrame:
    """(keys, attempt, applicable, explanation, code, final_applicable): what is applicable and comes with code must also be valid and use the strategy."""
    first = ask(df, keys, task, None).select(*keys, "attempt", F.coalesce("applicable", F.lit(False)).alias("applicable"), "explanation", F.col("code").alias("new_code"))
    coded = first.where("applicable AND new_code IS NOT NULL").join(df, keys)
    checked = ask(coded.withColumn("_attempt", F.col("attempt")).drop("attempt"), [*keys, "_attempt"], VERIFY, None)
    good = checked.select(*keys, F.col("_attempt").alias("attempt"), (F.col("is_valid") & F.col("uses_strategy")).alias("_ok"))
    out = first.join(good, [*keys, "attempt"], "left")
    needs = F.col("applicable") & F.col("new_code").isNotNull()
    return out.select(*keys, "attempt", "applicable", "explanation", F.col("new_code").alias("code"), F.when(needs, F.coalesce("_ok", F.lit(False))).otherwise(F.col("applicable")).alias("final_applicable"))


#: What an example shows, by kind of example.
EXAMPLES = {
    "before_and_diff": lambda: F.concat(F.coalesce("before", F.lit("")), F.lit("\n"), F.coalesce("diff", F.lit(""))),
    "diff": lambda: T.remove_fences(F.coalesce("diff", F.lit(""))),
    "summary": lambda: F.coalesce("summary", F.lit("")),
    "summary_and_diff": lambda: F.concat(F.coalesce("summary", F.lit("")), F.lit("\n"), T.remove_fences(F.coalesce("diff", F.lit("")))),
}


def optimise_with_examples(queries: DataFrame, found: DataFrame, texts: DataFrame, kind: str, ask: Ask, few: int = DEFAULTS.few_shot) -> DataFrame:
    """(q_id, attempt, status, code): a function of ``queries`` (q_id, code) made faster with its nearest examples before it.

    ``found``: q_id, d_id, score, rank; ``texts``: d_id, before, diff, summary. A query without examples is asked without.
    """
    ranked = found.where(F.col("rank") <= few).withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy("score", "d_id")))
    shown = ranked.join(texts.withColumn("text", EXAMPLES[kind]()).select("d_id", "text"), "d_id", "left")
    return ask(queries.join(completions.fewshot_text(shown, "q_id", "place", "text", "score"), "q_id", "left"), ["q_id"], TASKS["optimise"], None)


def related_summaries(found: DataFrame, texts: DataFrame, ask: Ask) -> DataFrame:
    """(d_id, explanation): every commit that some query found is explained once."""
    asked = texts.join(found.select("d_id").distinct(), "d_id", "left_semi")
    return ask(asked, ["d_id"], TASKS["explain"], None).where("status = 'success'").select("d_id", "explanation")


summarise_idea = partial(summarise, task=GENERAL_SUMMARY)
