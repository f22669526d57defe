"""Language-model tasks as opaque row maps: prompt, provider, parser. Providers are pluggable and replayable."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import text as T

#: Texts in, texts out (None: the call failed).
Provider = Callable[[list[str]], list[str | None]]


@dataclass(frozen=True)
class Task:
    """A prompt template over columns ({column}), how often to ask, and how an answer becomes columns."""

    name: str
    template: str
    parse: Callable[[Column], dict[str, Column]]
    attempts: int = 1
    retries: int = 3
    #: What is wrong with an answer, told to the model in the next try (None: nothing). It sees its prompt and its answer before.
    correct: Callable[[str], str | None] | None = None


def stub_provider(prompts: list[str]) -> list[str | None]:
    """A deterministic stand-in: answers from words of the prompt alone."""
    out = []
    for p in prompts:
        low = p.lower()
        yes = any(w in low for w in ("faster", "reserve", "cache", "optim", "avoid"))
        out.append(f'Summary: {p.strip().splitlines()[-1][:120] if p.strip() else ""}\nGeneric: {"true" if yes else "false"}\nEquivalent: {"true" if yes else "false"}\n```json\n{{"applicable": {"true" if yes else "false"}, "explanation": "stub"}}\n```')
    return out


def prompt(template: str, columns: list[str]) -> Column:
    """The template with {column} filled in; null is an empty text."""
    out, rest = [], template
    while rest:
        at = min(((rest.find("{" + c + "}"), c) for c in columns if "{" + c + "}" in rest), default=(-1, ""))
        if at[0] < 0:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[: at[0]]), F.coalesce(F.col(at[1]).cast("string"), F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out) if out else F.lit("")


def fan_out(df: DataFrame, attempts: int) -> DataFrame:
    return df.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))


def run(df: DataFrame, keys: list[str], task: Task, provider: Provider = stub_provider, done: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """(keys, attempt, request_id, completion, status, parsed columns) of every row and attempt that is not ``done``.

    A failed call has status error and null columns; the batch goes on. ``width`` bounds how many calls run at once.
    """
    asked = fan_out(df.withColumn("prompt", prompt(task.template, df.columns)), task.attempts)
    if done is not None:
        asked = asked.join(done.select(*keys, "attempt").distinct(), [*keys, "attempt"], "left_anti")
    if width:
        asked = asked.repartition(width)
    asked = asked.select(*keys, "attempt", "prompt")
    schema = asked.withColumn("completion", F.lit(None).cast("string")).withColumn("tries", F.lit(0)).schema
    retries = task.retries

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[str | None] = [None] * len(pdf)
            tries, asks = [0] * len(pdf), pdf.prompt.tolist()
            for _ in range(max(1, retries)):
                open_ = [i for i, g in enumerate(got) if g is None]
                if not open_:
                    break
                try:
                    answers = provider([asks[i] for i in open_])
                except Exception:  # noqa: BLE001 - a provider's failure is a row's status
                    answers = [None] * len(open_)
                for i, a in zip(open_, answers):
                    tries[i] += 1
                    wrong = task.correct(a) if a is not None and task.correct else None
                    if wrong is None:
                        got[i] = a
                    else:
                        asks[i] = f"{asks[i]}\n\n{a}\n\n{wrong}"
            yield pdf.assign(completion=got, tries=tries)

    out = asked.mapInPandas(call, schema)
    parsed = [c.alias(n) for n, c in task.parse(F.col("completion")).items()]
    status = F.when(F.col("completion").isNull(), "error").otherwise("success")
    return out.select(*keys, "attempt", T.request_id(F.lit(task.name), *[F.col(k).cast("string") for k in keys], F.col("attempt").cast("string")).alias("request_id"), "completion", status.alias("status"), *parsed)


def replay(df: DataFrame, generations: DataFrame, keys: list[str], task: Task) -> DataFrame:
    """As ``run``, with completions read from stored ``generations`` (keys, attempt, content); a missing one is an error."""
    asked = fan_out(df.select(*keys), task.attempts).join(generations.select(*keys, "attempt", F.col("content").alias("completion")), [*keys, "attempt"], "left")
    parsed = [c.alias(n) for n, c in task.parse(F.col("completion")).items()]
    return asked.select(*keys, "attempt", F.when(F.col("completion").isNull(), "error").otherwise("success").alias("status"), *parsed)


def one_code_block(answer: str) -> str | None:
    """What is wrong with an answer that must hold exactly one block of code."""
    n = len(re.findall(r"```(?:[a-zA-Z0-9+]*\n)?.*?```", answer, re.S))
    return None if n == 1 else "Your answer has no block of code; give the whole function in one." if n == 0 else "Your answer has several blocks of code; give only one."


def _summary(c: Column) -> dict[str, Column]:
    return {"summary": T.labelled(c, "Summary"), "generic": F.lower(T.labelled(c, "Generic")) == "true"}


def _verified(c: Column) -> dict[str, Column]:
    a = T.json_answer(c)
    return {"applicable": a["applicable"], "explanation": a["explanation"], "code": T.single_block(c)}


# Prompts of our own; only how answers are parsed and voted on is engine behaviour.
TASKS = {
    t.name: t
    for t in [
        Task("repository_domain", "Is this repository system software? Answer true or false.\n{name}\n{readme}", lambda c: {"is_system_software": T.is_true(T.strip(c))}),
        Task("is_optimization", "Does this commit make the program faster? Answer true, false or unknown.\n{message}", lambda c: {"is_opt": T.tri_state(c)}),
        Task("summarise_commit", "Summarise how this commit makes the code faster. Lines: Summary:, Generic:.\n{message}\n{diff}", _summary, attempts=5),
        Task("summarise_and_apply", "Apply the strategy to the code and say if the result is equivalent. Lines: Summary:, Generic:, Equivalent:.\n{message}\n{diff}", lambda c: {**_summary(c), "equivalent": T.equivalent_flag(c), "before": T.before_and_after(c)["before"], "after": T.before_and_after(c)["after"]}, attempts=5),
        Task("summarise_cluster", "What do these commits share? List when it applies.\n{summaries}", lambda c: {"strategy": T.labelled(c, "Summary"), "conditions": T.conditions(c)}, attempts=5),
        Task("strategy_applies", "Does the strategy apply to the function? Answer as JSON with applicable and explanation.\n{strategy}\n{code}", lambda c: {k: T.json_answer(c)[k] for k in ("applicable", "explanation")}, attempts=5),
        Task("strategy_applies_verified", "Rewrite the function by the strategy, then verify. Answer as JSON and one code block.\n{strategy}\n{code}", _verified, attempts=3),
        Task("optimise", "Make this function faster. One code block.\n{examples}\n{code}", lambda c: {"code": T.single_block(c)}, attempts=3, correct=one_code_block),
        Task("judge_similarity", "Do both changes use the same idea? SIMILAR or DIFFERENT.\n{diff_a}\n{diff_b}", lambda c: {"similar": T.says_similar(c, strict=True)}),
        Task("explain", "Explain this change.\n{diff}", lambda c: {"explanation": T.unwrap_fence(c)}),
    ]
}


def status_counts(results: DataFrame) -> DataFrame:
    """(status, n, share), in one pass over the results: the total is that of the few rows of counts."""
    per = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def fewshot_text(examples: DataFrame, key: str, place: str, text: str, score: str) -> DataFrame:
    """(key, examples): examples of a query in order of place, each with its score to one decimal. At most as many as were ranked."""
    one = F.format_string("Example %d (similarity %.1f)\n%s", F.col(place), F.col(score), F.coalesce(F.col(text), F.lit("")))
    return examples.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), one.alias("t")))), lambda x: x["t"]), "\n\n").alias("examples"))
