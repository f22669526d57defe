"""Source files that do not parse.

Each text is lexed to a string of token codes (``lexing``), one string for each way conditional compilation may go. Then
1. its distinct adjacent pairs become rows and are anti-joined against the pairs that the language's grammar permits (``grammars``);
2. its brackets become rows; nesting is a running sum over them, and every closing bracket is held against the
   previous bracket of its level (equal bracket sequences are checked once);
3. what is left is reduced, window by window, to statements and declarations (``productions``).
A file is invalid if any of the three finds a fault.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm import grammars, lexing, productions
from tarnwork.staging import stage

SALTS = 16
BROADCAST_KEYS = 500_000  # keys of faulty code strings (some 50 bytes each) that are broadcast; more are met by shuffle
_OPEN, _CLOSE = "([{u", ")]}v"


def language_of(path: Column) -> Column:
    """The language a file's ending tells, or null."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in lexing.LANGUAGES.items() for x in kv]), ending)


def insert_semicolons(codes: str, fresh: str, permitted: frozenset[str]) -> str:
    """JavaScript codes with the semicolons that line breaks, closing braces and the end of the text stand for."""
    out: list[str] = []
    parens: list[str] = []
    head = False  # whether the bracket just closed belongs to if, for, while, switch or catch
    for c, new in zip(codes, fresh):
        prev = out[-1] if out else "^"
        if prev not in ";^{k" and (not parens or parens[-1] == "{"):
            if new == "1" and (prev == ")" and not head and c in "inslRIFWDSCdBYfKgTMxz"):
                out.append(";")
            elif new == "1" and (prev + c not in permitted or prev in "RB" or c == "x" or (prev in "inv)]s" and c in "i")):
                out.append(";")
            elif c == "}" and prev + c not in permitted:
                out.append(";")
        if c in "([{up":
            parens.append("h" if c == "(" and prev in "IFWSH" else c)
        elif c in ")]}vP" and parens:
            head = parens.pop() == "h"
        out.append(c)
    if out and out[-1] not in ";}":
        out.append(";")
    return "".join(out)


def code_strings(text: str, language: str) -> list[str]:
    got = lexing.lex(text, language)
    if language == "JavaScript":
        return [insert_semicolons(got[0], got[1], grammars.permissible(language))]
    return got


_BRACKETS = {c for c in _OPEN + _CLOSE}


def lexed(files: DataFrame, file_id: str, path: str, content: str) -> DataFrame:
    """(file_id, language, codes, pairs, brackets), one row for each variant of a text that is not null or blank."""
    given = files.select(F.col(file_id).cast("long").alias("file_id"), language_of(F.col(path)).alias("language"), F.col(content).alias("content")).where(F.col("language").isNotNull() & F.col("content").rlike(r"\S"))

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop = {i: None for i in range(128) if chr(i) not in _BRACKETS}
        for pdf in batches:
            rows = []
            for i, language, text in zip(pdf.file_id, pdf.language, pdf.content):
                for codes in code_strings(text, language):
                    pairs = set(map(str.__add__, "^" + codes, codes + "$"))
                    rows.append((i, language, codes, list(pairs), codes.translate(drop)))
            yield pd.DataFrame(rows, columns=["file_id", "language", "codes", "pairs", "brackets"])

    return given.mapInPandas(lex, "file_id long, language string, codes string, pairs array<string>, brackets string")


def permissible_pairs(spark) -> DataFrame:
    """(language, pair); a fixed table of some thousands of rows."""
    rows = [(lang, p) for lang in sorted(set(lexing.LANGUAGES.values())) for p in sorted(grammars.permissible(lang))]
    return spark.createDataFrame(rows, "language string, pair string")


def text_key(text: Column) -> Column:
    """struct of two digests by which equal texts meet, so that no row needs to carry its whole text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b"))


def unpaired_keys(strings: DataFrame) -> DataFrame:
    """The ``key`` of the rows of ``strings`` (key, brackets), one a key, in which brackets do not pair. A row of brackets has a key, not a text."""
    rows = strings.where("brackets <> ''").select("key", F.posexplode(F.split("brackets", "")).alias("pos", "c")).where("c <> ''")
    opening = F.instr(F.lit(_OPEN), F.col("c")) > 0
    by_pos = Window.partitionBy("key").orderBy("pos")
    depth = F.sum(F.when(opening, 1).otherwise(-1)).over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
    # an opening bracket and the one that closes it have the same level
    level = F.when(opening, F.col("depth")).otherwise(F.col("depth") + 1)
    rows = rows.withColumn("opening", opening).withColumn("depth", depth).withColumn("level", level)
    before = F.lag("c").over(Window.partitionBy("key", "level").orderBy("pos"))
    partner = F.translate("c", _CLOSE, _OPEN)
    fault = (F.col("depth") < 0) | (~F.col("opening") & F.coalesce(before != partner, F.lit(True)))
    return rows.withColumn("fault", fault).groupBy("key").agg(F.max("fault").alias("fault"), F.max_by("depth", "pos").alias("end")).where("fault OR end <> 0").select("key")


def badly_nested(brackets: DataFrame) -> DataFrame:
    """The distinct bracket strings of ``brackets`` (brackets) in which brackets do not pair."""
    once = brackets.select("brackets").distinct().withColumn("key", text_key(F.col("brackets")))
    return once.join(unpaired_keys(once), "key", "left_semi").select("brackets")


def invalid_files(files: DataFrame, *, file_id: str, path: str, content: str) -> DataFrame:
    """(file_id, language): files that are not valid in the language of their path, once each.

    Null and blank contents and paths of other endings are no case. Repeated rows give one; of rows with one id and
    different contents any invalid one counts. An empty table gives an empty result; extra columns are ignored.
    """
    spark = files.sparkSession
    codes = stage(lexed(files, file_id, path, content).withColumns({"key": text_key(F.concat_ws(" ", "language", "codes")), "bracket_key": text_key(F.col("brackets"))}), "token_codes")
    pairs = codes.select("key", "language", F.explode("pairs").alias("pair"))
    strange = pairs.join(F.broadcast(permissible_pairs(spark)), ["language", "pair"], "left_anti").select("key").distinct()
    # equal bracket strings are looked at once
    unpaired = stage(unpaired_keys(codes.groupBy(F.col("bracket_key").alias("key")).agg(F.first("brackets").alias("brackets"))), "unpaired_brackets")
    nested = codes.select("key", "bracket_key").join(unpaired.withColumnRenamed("key", "bracket_key"), "bracket_key", "left_semi").select("key")
    flagged = stage(strange.unionByName(nested).distinct(), "flagged_codes")

    @F.pandas_udf("boolean")
    def holds(language: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([productions.checker(lang).valid(c) for lang, c in zip(language, codes)])

    # what is flagged need not be reduced; keys that are known by now are broadcast while they are few
    unreduced = codes.join(flagged, "key", "left_anti").where(~holds("language", "codes")).select("key").distinct()
    bad = stage(flagged.unionByName(unreduced), "bad_codes")
    mine = codes.select("file_id", "language", "key")
    if bad.count() <= BROADCAST_KEYS:
        return mine.join(F.broadcast(bad), "key", "left_semi").select("file_id", "language").distinct()
    # one code string may be that of a third of all files: it is met under salts
    salted = mine.withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int"))
    met = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return salted.join(met, ["key", "salt"], "left_semi").select("file_id", "language").distinct()


def invalid_rates(files: DataFrame, invalid: DataFrame, *, file_id: str, path: str, content: str, repository: str) -> DataFrame:
    """(repository, language, n_files, n_invalid, rate) over the files with a content; a null repository is a group."""
    once = files.where(F.col(content).rlike(r"\S")).select(F.col(file_id).alias("file_id"), F.col(repository).alias("repository"), language_of(F.col(path)).alias("language")).where("language IS NOT NULL").distinct()
    flagged = once.join(invalid.select("file_id", F.lit(1).alias("bad")), "file_id", "left")
    return flagged.groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid")).withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
