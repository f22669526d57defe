"""Text expressions. All are lazy Column functions; null in gives null out unless stated."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of C and C++ sources, as the funnel takes them (any case) and as attribution does (as written).
C_EXTENSIONS = [".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"]
C_SUFFIX = r"\.(c|cpp|cc|h|hpp)$"


def strip(c: Column) -> Column:
    """Outer white space of any kind goes (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def contains_any(c: Column, words: list[str], word_boundary: bool = False) -> Column:
    """Whether the lower-cased text holds any of ``words`` as a substring (or as whole words). No words: false."""
    low = F.lower(c)
    if not words:
        return F.when(c.isNotNull(), F.lit(False))
    if word_boundary:
        import re

        return low.rlike(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b")
    out = low.contains(words[0].lower())
    for w in words[1:]:
        out = out | low.contains(w.lower())
    return out


def extension(path: Column) -> Column:
    """Lower-cased ending with its dot; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def commit_url(repo_url: Column, commit: Column) -> Column:
    return F.concat(F.regexp_replace(repo_url, r"\.git$", ""), F.lit("/commit/"), commit)


def owner_and_repo(url: Column) -> Column:
    """struct(owner, repo) of a hosting URL; empty strings if it is none. The repo keeps a .git."""
    p = r"^(?:https?://|git@)[^/:]+[/:]([^/]+)/(.+?)/?$"
    return F.struct(F.regexp_extract(url, p, 1).alias("owner"), F.regexp_extract(url, p, 2).alias("repo"))


def composite_key(*cols: Column, sep: str = "::") -> Column:
    return F.concat_ws(sep, *cols)


def split_key(c: Column, sep: str = "::") -> Column:
    """struct(head, tail) at the first separator; tail is null if there is none."""
    at = F.instr(c, sep)
    return F.struct(F.when(at > 0, F.substring_index(c, sep, 1)).otherwise(c).alias("head"), F.when(at > 0, c.substr(at + len(sep), F.length(c))).alias("tail"))


def fenced_blocks(c: Column) -> Column:
    """The stripped contents of ``` blocks, in order; an empty array for none."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```(?:[a-zA-Z0-9+]*\n)?(.*?)```"), F.lit(1)), strip)


def single_block(c: Column) -> Column:
    """The only fenced block, or null if there is none or more than one."""
    b = fenced_blocks(c)
    return F.when(F.size(b) == 1, b[0])


def unwrap_fence(c: Column) -> Column:
    """Without one outer fence, if the first and the last line are fences."""
    lines = F.split(strip(c), "\n")
    wrapped = (F.size(lines) >= 2) & F.element_at(lines, 1).startswith("```") & F.element_at(lines, -1).startswith("```")
    return F.when(wrapped, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(c)


def remove_fences(c: Column) -> Column:
    return F.regexp_replace(c, r"```[a-zA-Z0-9+]*\n?", "")


def labelled(c: Column, label: str) -> Column:
    """The text after the last line that starts with ``label:`` in any case, stripped; null for none."""
    got = F.regexp_extract_all(c, F.lit(rf"(?im)^[ \t]*{label}:[ \t]*([^\n]*)$"), F.lit(1))
    return F.when(F.size(got) > 0, strip(F.element_at(got, -1)))


def equivalent_flag(c: Column) -> Column:
    """true or false after ``Equivalent:``, else null."""
    got = F.lower(F.regexp_extract(c, r"(?i)Equivalent:\s*(true|false)", 1))
    return F.when(got == "true", True).when(got == "false", False)


def before_and_after(c: Column) -> Column:
    """struct(before, after): the blocks under the headings Before and After, or the first two fenced blocks."""
    blocks = fenced_blocks(c)

    def under(head: str) -> Column:
        got = F.regexp_extract(c, rf"(?is)\b{head}\b[^\n]*\n\s*```(?:[a-zA-Z0-9+]*\n)?(.*?)```", 1)
        return F.when(got != "", strip(got))

    return F.struct(F.coalesce(under("before"), F.get(blocks, F.lit(0))).alias("before"), F.coalesce(under("after"), F.get(blocks, F.lit(1))).alias("after"))


def json_answer(c: Column) -> Column:
    """struct(applicable, explanation, parsed) of a model's JSON answer.

    The object in the first ```json block, or else the whole text. Without both keys: applicable if the text holds
    "true" and "applicable" in any case, and the text cut to 497 characters and "..." as explanation.
    """
    fenced = F.regexp_extract(c, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    obj = F.from_json(F.when(fenced != "", fenced).otherwise(c), "applicable boolean, explanation string")
    ok = obj["applicable"].isNotNull() & obj["explanation"].isNotNull()
    low = F.lower(c)
    cut = F.when(F.length(c) > 500, F.concat(F.substring(c, 1, 497), F.lit("..."))).otherwise(c)
    return F.struct(
        F.when(ok, obj["applicable"]).otherwise(low.contains("true") & low.contains("applicable")).alias("applicable"),
        F.when(ok, obj["explanation"]).otherwise(cut).alias("explanation"),
        ok.alias("parsed"),
    )


def conditions(c: Column, most: int = 3) -> Column:
    """Items of a numbered or bulleted list (else the lines), the first ``most``, each cut to its first sentence."""
    items = F.filter(F.regexp_extract_all(c, F.lit(r"(?ms)^[ \t]*(?:\d+\.|[-*])[ \t]+(.*?)(?=^[ \t]*(?:\d+\.|[-*])[ \t]|\z)"), F.lit(1)), lambda x: strip(x) != "")
    lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    return F.transform(F.slice(F.when(F.size(items) > 0, items).otherwise(lines), 1, most), lambda x: first_sentence(strip(x)))


def first_sentence(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")[0]


def code_pairs(c: Column) -> Column:
    """A JSON array of pairs, or an empty array."""
    got = F.from_json(c, "array<array<string>>")
    return F.coalesce(got, F.array().cast("array<array<string>>"))


def tri_state(c: Column) -> Column:
    """"true", "false" or "unknown"; anything else is "unknown"."""
    low = F.lower(strip(c))
    return F.when(low.isin("true", "false"), low).otherwise("unknown")


def is_true(c: Column) -> Column:
    """Whether the text is "true" in any case; null is false."""
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def says_similar(c: Column, strict: bool = False) -> Column:
    """Whether a verdict holds SIMILAR (also as part of a word), or with ``strict`` starts with it."""
    up = F.upper(c)
    return F.coalesce(strip(up).rlike(r"^SIMILAR\b") if strict else up.contains("SIMILAR"), F.lit(False))


def truncate(c: Column, size: int = 2000, mark: str = "") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(mark))).otherwise(c)


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0 or null."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def request_id(*parts: Column) -> Column:
    """A repeatable identifier of a request: a digest of its parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def decode_bytes(b: Column) -> Column:
    """UTF-8 where the bytes are valid, else ISO-8859-1."""
    return F.when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8")).otherwise(F.decode(b, "ISO-8859-1"))


def parse_offset_time(c: Column) -> Column:
    """An ISO time with offset as timestamp; unusable values are null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss XX")), F.try_to_timestamp(c))


def ascii_tokens(c: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Runs of ASCII letters of the lower-cased text, of between ``shortest`` and ``longest`` letters; null text: no token."""
    got = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return F.filter(got, lambda t: F.length(t).between(shortest, longest))


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Characters of the basic plane that carry a mark, and what they are without it."""
    plain = {}
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0xFFFE)]):
        parts = unicodedata.normalize("NFD", c)
        bare = unicodedata.normalize("NFC", "".join(x for x in parts if unicodedata.category(x) != "Mn"))
        if len(parts) > 1 and len(bare) == 1 and bare != c:
            plain[c] = bare
    return "".join(plain), "".join(plain.values())


def without_accents(c: Column) -> Column:
    """Letters without their marks, in any script."""
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{Mn}+", "")


def word_tokens(c: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Runs of letters of any script and underscores, without accents, lower-cased, not starting with _; null: none."""
    got = F.regexp_extract_all(without_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit(r"([\p{L}\p{Nl}\p{No}_]+)"), F.lit(1))
    return F.filter(got, lambda t: F.length(t).between(shortest, longest) & ~t.startswith("_"))


def blank_tokens(c: Column) -> Column:
    """What stands between white space; null and blank texts: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def word_count(c: Column) -> Column:
    """Tokens by white space and punctuation, the offline stand-in for a model's tokenizer."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\w+|[^\w\s])"), F.lit(1)))


def cluster_name(label: Column) -> Column:
    """Labels counted from 1; -1 is noise."""
    return F.when(label == -1, F.lit("noise")).otherwise((label + 1).cast("string"))


def pretty_json(c: Column, schema: str) -> Column:
    """A JSON text of the given schema, indented; null where it does not parse."""
    return F.to_json(F.from_json(c, schema), {"pretty": "true"})


def kb_to_gb(c: Column) -> Column:
    return c / 1048576
