"""Functions of C-like sources: where they are, which of them a change touches, and splicing."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import C_SUFFIX

SPAN = "name string, start_line int, end_line int"
CHANGE = "id int, type string, old_start int, old_end int, new_start int, new_end int, function string, old_content string, new_content string"

# How a definition opens, and words before a bracket that are none.
_HEAD = r"^\s*(?:[\w:<>,~*&]+\s+)*((?:[\w:]+::)?[\w~]+)\s*\("
_ONE_LINE = re.compile(_HEAD + r"[^)]*\)(?:\s*const)?\s*(?:throw\s*\([^)]*\))?\s*(?:override\s*)?\s*\{[^}]*\}")
_CONSTRUCTOR = re.compile(r"^\s*([\w~]+)\s*\([^{;]*\)(?:\s*:\s*\w+\s*\([^)]*\).*)?")
_GENERAL = re.compile(_HEAD)
_CONTROL = re.compile(r"\b(?:if|else|for|while|switch|do|catch)\s*\(")
LOOK_AHEAD = 10


def text_lines(text: str | None) -> list[str]:
    """Lines with their ends. Only \\n, \\r\\n and \\r end a line; other separators, such as a form feed, stand inside one."""
    return re.findall(r"[^\n]*\n|[^\n]+", (text or "").replace("\r\n", "\n").replace("\r", "\n"))


def function_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(name, first line, last line), lines from 1, of the functions in a source.

    A scanner by lines, which is idle or waits for the { of a declared function; in both states blank lines and lines that start with # are
    passed over. A head counts as a definition if a { comes within ``LOOK_AHEAD`` lines before one that ends in ;. A body runs over all lines
    until its braces balance, in texts and comments too, and the scan goes on behind it, so nested functions are not reported. A body
    that does not close, or closes more than it opened, gives nothing and is passed over, but for that of a head that
    reads like a constructor's: this is tried as a general head once more.
    """
    lines = text_lines(text)
    braces = [s.count("{") - s.count("}") for s in lines]
    rounds = [s.count("(") - s.count(")") for s in lines]
    spans: list[tuple[str, int, int]] = []

    def body(name: str, start: int, at: int) -> tuple[bool, int]:
        """(whether the body that opens on line ``at`` is closed, the line to go on with); a closed one is reported."""
        depth, k = braces[at], at + 1
        while k < len(lines) and depth > 0:
            depth += braces[k]
            k += 1
        if depth == 0:
            spans.append((name, start + 1, k))
        return depth == 0, k

    def opening(at: int) -> int | None:
        """The first line from ``at`` on that has a {, unless a declaration ends before it."""
        for k in range(at, min(at + LOOK_AHEAD, len(lines))):
            if "{" in lines[k]:
                return k
            if lines[k].strip().endswith(";"):
                return None
        return None

    waiting: tuple[str, int] | None = None  # (name, first line) of a function whose { is to come
    open_rounds, i = 0, 0
    while i < len(lines):
        line = lines[i]
        if not line.strip() or line.strip().startswith("#"):
            i += 1
            continue
        if waiting:
            open_rounds += rounds[i]
            if "{" in line and open_rounds <= 0:
                (name, start), waiting = waiting, None
                i = body(name, start, i)[1]
            else:
                i += 1
            continue
        if _CONTROL.search(line):
            i += 1
            continue
        if m := _ONE_LINE.match(line):
            spans.append((m.group(1), i + 1, i + 1))
            i += 1
            continue
        at = opening(i)
        if at is not None and (m := _CONSTRUCTOR.match(line)):
            closed, after = body(m.group(1), i, at)
            if closed:
                i = after
                continue
            waiting = m.group(1), i
        if at is not None and (m := _GENERAL.match(line)):
            waiting, open_rounds = (m.group(1), i), rounds[i]
            if "{" in line and open_rounds <= 0:
                waiting = None
                i = body(m.group(1), i, i)[1]
                continue
        i += 1
    return spans


def changes(before: str | None, after: str | None) -> list[tuple]:
    """Rows of ``CHANGE``: the differing runs of lines, each charged to one function.

    Inserted and replaced lines go to the first function of the new text that holds the first of them, deleted ones to
    that of the old text; none: null. Ends are exclusive. What an insertion has of the old text, or a deletion of the new one, is null.
    """
    old, new = text_lines(before), text_lines(after)
    old_spans, new_spans = function_spans(before), function_spans(after)
    out = []
    for kind, i1, i2, j1, j2 in difflib.SequenceMatcher(None, old, new).get_opcodes():
        if kind == "equal":
            continue
        line, spans = (i1 + 1, old_spans) if kind == "delete" else (j1 + 1, new_spans)
        owner = next((n for n, a, b in spans if a <= line <= b), None)
        out.append((len(out) + 1, kind, i1 + 1, i2 + 1, j1 + 1, j2 + 1, owner, "".join(old[i1:i2]) or None, "".join(new[j1:j2]) or None))
    return out


def function_text(text: str | None, name: str) -> str | None:
    """The lines of the first function of that name, or null."""
    for n, a, b in function_spans(text):
        if n == name:
            return "".join(text_lines(text)[a - 1 : b]).removesuffix("\n")
    return None


def parse_functions(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, name, start_line, end_line), one row per function; null and empty texts have none."""
    schema = df.select(*key).schema.simpleString()[7:-1]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, *s) for *k, t in pdf.itertuples(index=False) for s in function_spans(t)]
            yield pd.DataFrame(rows, columns=[*key, "name", "start_line", "end_line"])

    return df.select(*key, text).mapInPandas(scan, _ddl(schema) + ", " + SPAN)


def _ddl(simple: str) -> str:
    return ", ".join(x.replace(":", " ", 1) for x in simple.split(","))


def attribute_changes(df: DataFrame, key: list[str], before: str, after: str) -> DataFrame:
    """(key, change fields), one row per change; equal texts have none."""
    schema = _ddl(df.select(*key).schema.simpleString()[7:-1])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, *c) for *k, b, a in pdf.itertuples(index=False) for c in changes(b, a)]
            yield pd.DataFrame(rows, columns=[*key, *[x.split()[0] for x in CHANGE.split(", ")]])

    return df.select(*key, before, after).mapInPandas(scan, f"{schema}, {CHANGE}")


def modified_functions(changed: DataFrame, key: list[str]) -> DataFrame:
    """(key, modified_func_count, modified_func, modified_other, inserts, deletes, replaces) from attributed changes; names in order of their first change."""
    kinds = ("insert", "delete", "replace")
    per = changed.groupBy(*key, "function").agg(F.min("id").alias("_id"), *[F.count_if(F.col("type") == t).alias(f"{t}s") for t in kinds])
    named = F.when(F.col("function").isNotNull(), F.struct("_id", "function"))
    return per.groupBy(*key).agg(
        F.count("function").alias("modified_func_count"), F.transform(F.array_sort(F.collect_list(named)), lambda x: x["function"]).alias("modified_func"),
        F.bool_or(F.col("function").isNull()).alias("modified_other"), *[F.sum(f"{t}s").alias(f"{t}s") for t in kinds],
    )


def function_changes(changed: DataFrame, key: list[str]) -> DataFrame:
    """(key, function, inserts, deletes, replaces, ids): the changes of each function, and under a null function those outside of all."""
    return changed.groupBy(*key, "function").agg(*[F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("insert", "delete", "replace")], F.array_sort(F.collect_list("id")).alias("ids"))


def commit_rows(files: DataFrame, key: list[str], path: str, before: str, after: str) -> DataFrame:
    """(key, modified_func_count, modified_func, modified_other, before_func, after_func), one row per commit.

    ``files`` has a row per changed file with both texts. Files of other endings than ``C_SUFFIX`` (as written) or without one of the texts do
    not count: a commit of only such has counts of 0. The function's texts are given if exactly one function, and nothing
    outside functions, was changed; one of them is null if the function was added or removed. Names come in order of path and change.
    """
    schema = _ddl(files.select(*key).schema.simpleString()[7:-1])
    fields = "path string, names array<string>, other boolean, before_func string, after_func string"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *k, p, b, a in pdf.itertuples(index=False):
                got = changes(b, a)
                names = list(dict.fromkeys(c[6] for c in got if c[6] is not None))
                one = names[0] if len(names) == 1 else None
                rows.append((*k, p, names, any(c[6] is None for c in got), one and function_text(b, one), one and function_text(a, one)))
            yield pd.DataFrame(rows, columns=[*key, "path", "names", "other", "before_func", "after_func"])

    counts = F.coalesce(F.col(path).rlike(C_SUFFIX), F.lit(False)) & F.col(before).isNotNull() & F.col(after).isNotNull()
    per_file = files.where(counts).select(*key, path, before, after).mapInPandas(scan, f"{schema}, {fields}")
    texts = F.when(F.coalesce("before_func", "after_func").isNotNull(), F.struct("path", "before_func", "after_func"))
    out = per_file.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path", "names"))).alias("_n"), F.bool_or("other").alias("modified_other"), F.min(texts).alias("_t"))
    out = out.withColumn("modified_func", F.array_distinct(F.flatten(F.transform("_n", lambda x: x["names"])))).withColumn("_one", (F.size("modified_func") == 1) & ~F.col("modified_other"))
    found = out.select(*key, "modified_func", "modified_other", F.when(F.col("_one"), F.col("_t.before_func")).alias("before_func"), F.when(F.col("_one"), F.col("_t.after_func")).alias("after_func"))
    every = files.select(*key).distinct()
    none = every.join(found, key, "left_anti").select(*key, F.array().cast("array<string>").alias("modified_func"), F.lit(False).alias("modified_other"), F.lit(None).cast("string").alias("before_func"), F.lit(None).cast("string").alias("after_func"))
    return found.unionByName(none).select(*key, F.size("modified_func").cast("long").alias("modified_func_count"), "modified_func", "modified_other", "before_func", "after_func")


def splice(text, start, end, replacement):
    """Column: ``text`` with lines start to end (from 1, inclusive) replaced."""
    lines = F.split(text, "\n")
    head = F.slice(lines, 1, F.greatest(start - 1, F.lit(0)))
    tail = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.array_join(F.concat(head, F.array(replacement), tail), "\n")


def add_include(text, include: str):
    """Column: ``include`` put behind #pragma once (or first), unless it is there."""
    line = F.lit(f"#include {include}")
    after = F.regexp_replace(text, r"(?m)^(#pragma once[^\n]*)$", f"$1\n#include {include}")
    return F.when(text.contains(f"#include {include}"), text).when(text.rlike(r"(?m)^#pragma once"), after).otherwise(F.concat(line, F.lit("\n"), text))


def unified_diff(df: DataFrame, before: str, after: str, output: str = "diff") -> DataFrame:
    """Adds the unified diff of two texts; null counts as empty."""

    @F.pandas_udf("string")
    def diff(b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff(text_lines(x), text_lines(y), "before", "after")) for x, y in zip(b, a)])

    return df.withColumn(output, diff(before, after))


def change_report(changed: DataFrame, key: list[str]) -> DataFrame:
    """(key, report): the changes of a key as JSON, in order."""
    fields = [c for c in changed.columns if c not in key]
    return changed.groupBy(*key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("report"))
