"""Evaluation passages in documents: one Aho-Corasick automaton, one scan, then alignment.

Items and documents are taken as sequences of normalised words (case, punctuation, markup, layout, invisible characters
and line-break hyphens make no difference); every document word keeps its offsets in the original text.
The patterns are the runs of ``SEED`` consecutive words of the items. Why that finds all: of w >= MIN_WORDS
words at most w / 5 are altered, so at least 4w / 5 intact words lie in at most w / 5 + 1 stretches, and for w > 15
some stretch has more than three words, that is at least ``SEED``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.staging import stage

SEED = 4
MIN_WORDS = 18
ERROR_SHARE = 5  # one altered word in so many
OWN_ITEMS = 4  # a word of at most so many items tells them from others of the same style
#: Words of test items in one automaton; more items are scanned in several blocks, so that no broadcast outgrows it.
BLOCK_WORDS = 2_000_000

_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿"
# a word: letters, digits, marks; inside it also invisible characters, apostrophes, hyphens and a hyphen at a line break,
# which may be followed by the marks that open a comment, quotation or list line
_WORD = re.compile(
    rf"[^\W_](?:[\w{_INVISIBLE}]|['’](?=\w)|[-‐‑](?=\w)|[-‐‑­][ \t]*\r?\n[ \t]*(?:(?://+|#+|\*+|>+|;+|\+|\||-)[ \t]*)?(?=\w))*"
)
_DROP = re.compile(rf"[^\w]|_+$|[{_INVISIBLE}]|(?<=[-‐‑­\n])_+")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]{0,80})?/?>|&(?:[a-z]{2,6}|#\d{1,6});")


def words(text: str | None) -> list[tuple[str, int, int]]:
    """(normalised word, start, end) of each word."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    out = []
    for m in _WORD.finditer(text):
        w = m.group()
        if not (w.isascii() and w.isalnum()):
            w = _DROP.sub("", unicodedata.normalize("NFKC", w))
        if w:
            out.append((w.lower(), m.start(), m.end()))
    return out


_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")


def without_shared_opening(texts: list[str]) -> list[list[str]]:
    """The words of each item after the opening sentences that it shares with other items."""
    parts = [[[w for w, _, _ in words(s)] for s in _SENTENCE.split(t or "") if s.strip()] for t in texts]
    at = [0] * len(parts)
    live = list(range(len(parts)))
    while live:
        by = defaultdict(set)
        for i in live:
            if at[i] < len(parts[i]):
                by[tuple(map(tuple, parts[i][: at[i] + 1]))].add(i)
        # the same item given twice is no shared opening: other text must follow
        live = []
        for group in by.values():
            if len({tuple(map(tuple, parts[i])) for i in group}) > 1:
                for i in group:
                    at[i] += 1
                    live.append(i)
    return [[w for s in p[a:] for w in s] for p, a in zip(parts, at)]


#: The longest passage that must be looked for: of a longer one, cut between two intact neighbours with ``MIN_WORDS`` on both
#: sides, one part is a passage too. (Were there no such neighbours, more than one word in ERROR_SHARE would be altered.)
MOST_WORDS = (2 * MIN_WORDS - 1) * ERROR_SHARE // (ERROR_SHARE - 2)
#: Errors in it, and so by how much a passage leaves the diagonal of any of its words.
SLACK = MOST_WORDS // ERROR_SHARE
PIECE = 2048  # document words that are aligned at a time; pieces overlap by the longest passage


def holds_passage(item: list[str], doc: list[str], own: set[str] | frozenset[str] = frozenset()) -> tuple[int, int] | None:
    """(first, last) place in ``doc`` of a passage of the item, or None.

    A passage is an alignment of at least MIN_WORDS consecutive item words with doc words in order, the first and the last of
    them intact, in which altered, missing and foreign words together are at most one in ERROR_SHARE of the item's words; they may
    stand side by side. Of ``own``, the words that tell the item from others in the same style, at least half must occur: a
    question of the same style differs in just these.
    """
    there = set(doc)
    # bound: were every item word that occurs in the document matched, where could a passage begin?
    times = Counter(item)
    flag = lambda f: np.fromiter(map(f, item), dtype=bool, count=len(item))
    starts = np.nonzero(_starts(flag(there.__contains__), flag(own.__contains__), flag(lambda w: times[w] == 1)))[0]
    if not len(starts):
        return None
    number = {w: k for k, w in enumerate(dict.fromkeys(item))}
    x = np.fromiter((number[w] for w in item), dtype="int64", count=len(item))
    y = np.fromiter((number.get(w, -1) for w in doc), dtype="int64", count=len(doc))
    for lo in range(0, len(doc), PIECE):
        for s, length, first, last in _alignments(x, y[lo : lo + PIECE + MOST_WORDS + SLACK], starts):
            telling = own.intersection(item[s : s + length])
            if 2 * len(telling.intersection(doc[lo + first : lo + last + 1])) >= len(telling):
                return lo + first, lo + last
    return None


def _alignments(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first item word, item words, first doc word, last doc word) of each passage that begins at one of ``starts``, shorter ones first.

    Edit distances of all item parts from these places on, a row a word, over all doc words at once; the high bits
    of a cell are its errors, the low ones the doc word where it began.
    """
    n, one, far = len(x), 1 << 32, np.int64(1 << 50)
    column = np.arange(len(y), dtype="int64")
    along = column * one
    same = x[:, None] == y[None]
    at = starts[same[starts].any(axis=1)]
    v = np.where(same[at], column[None], far)
    for r in range(1, min(MOST_WORDS, n)):
        if len(at) and at[-1] + r >= n:
            stay = at + r < n
            at, v = at[stay], v[stay]
        if not len(at) or v.min() >= (SLACK + 1) * one:
            return
        hit = same[at + r]
        met = np.full_like(v, far)
        met[:, 1:] = v[:, :-1] + np.where(hit[:, 1:], 0, one)
        if r + 1 >= MIN_WORDS:
            ends = hit & (met < ((r + 1) // ERROR_SHARE + 1) * one)
            for s, j in np.argwhere(ends):
                yield int(at[s]), r + 1, int(met[s, j] & (one - 1)), int(j)
        v = np.minimum(met, v + one)  # an item word goes with the next doc word, or is missing
        v = np.minimum.accumulate(v - along, axis=1) + along  # foreign words


def _starts(hit: np.ndarray, own: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Where a passage could begin if all words that occur in the document (``hit``) were in their place; flags by (item, word) or by word.

    Bounds of what a passage asks for: intact words, four to an altered one; and of the words of ``own`` as many that occur as that do not (of
    the latter only those that stand ``once`` in their item are sure to count).
    """
    zero = np.zeros((*hit.shape[:-1], 1), dtype="int64")
    run = np.concatenate([zero, np.cumsum(np.where(hit, 1, 1 - ERROR_SHARE), axis=-1)], axis=-1)
    tell = np.concatenate([zero, np.cumsum(np.where(own, np.where(hit, 1, np.where(once, -1, 0)), 0), axis=-1)], axis=-1)
    out = np.zeros(hit.shape, dtype=bool)
    for size in range(MIN_WORDS, min(MOST_WORDS, hit.shape[-1]) + 1):
        out[..., : run.shape[-1] - size] |= (run[..., size:] >= run[..., :-size]) & (tell[..., size:] >= tell[..., :-size])
    return out & hit


def own_words(items: list[list[str]]) -> set[str]:
    """Words of at most ``OWN_ITEMS`` items."""
    df: dict[str, int] = defaultdict(int)
    for ws in items:
        for w in set(ws):
            df[w] += 1
    return {w for w, n in df.items() if n <= OWN_ITEMS}


class Finder:
    """The automaton over the seeds of some items."""

    def __init__(self, items: list[tuple[int, list[str]]], own: set[str] | None = None):
        import ahocorasick

        self.items = [(k, ws) for k, ws in items if len(ws) >= SEED]
        self.own = own_words([ws for _, ws in items]) if own is None else own
        seeds = defaultdict(list)
        for row, (_, ws) in enumerate(self.items):
            for i in range(len(ws) - SEED + 1):
                seeds[" " + " ".join(ws[i : i + SEED]) + " "].append((row, i))
        self.automaton = ahocorasick.Automaton()
        self.at = [np.array(at, dtype="int64") for at in seeds.values()]  # (item, place) of each seed
        for k, s in enumerate(seeds):
            self.automaton.add_word(s, k)
        self.empty = not seeds
        self.known: dict[str, str] = {}
        if seeds:
            self.automaton.make_automaton()
        # numbers of the items' words, and each item as a row of them; the last number is no word
        self.number: dict[str, int] = {}
        for _, ws in self.items:
            for w in ws:
                self.number.setdefault(w, len(self.number))
        shape = len(self.items), max([len(ws) for _, ws in self.items], default=0)
        self.rows = np.full(shape, len(self.number), dtype="int64")
        self.own_at, self.once = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        for row, (_, ws) in enumerate(self.items):
            times = Counter(ws)
            self.rows[row, : len(ws)] = [self.number[w] for w in ws]
            self.own_at[row, : len(ws)] = [w in self.own for w in ws]
            self.once[row, : len(ws)] = [times[w] == 1 for w in ws]

    def flat(self, text: str) -> str:
        """The words of ``words(text)`` between blanks, without their offsets."""
        if "<" in text or "&" in text:
            text = _TAG.sub(lambda m: " " * len(m.group()), text)
        known, out = self.known, []
        for w in _WORD.findall(text):
            if (n := known.get(w)) is None:
                n = w if w.isascii() and w.isalnum() else _DROP.sub("", unicodedata.normalize("NFKC", w))
                n = n.lower()
                if len(known) < 200_000:
                    known[w] = n
            if n:
                out.append(n)
        return " " + " ".join(out) + " "

    def possible(self, rows: np.ndarray, doc: list[str]) -> np.ndarray:
        """Those of the items that could have a passage if every word they share with the document were in its place."""
        there = np.zeros(len(self.number) + 1, dtype=bool)
        get = self.number.get
        there[[k for w in set(doc) if (k := get(w)) is not None]] = True
        return rows[_starts(there[self.rows[rows]], self.own_at[rows], self.once[rows]).any(axis=1)]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, start, end) with offsets in the original text, one per item that leaked."""
        if self.empty or not text or next(self.automaton.iter(self.flat(text)), None) is None:
            return []
        found = words(text)
        plain = [w for w, _, _ in found]
        ends = np.cumsum([len(w) + 1 for w in plain])  # of each word in the flat text, with the blank before it
        got = list(self.automaton.iter(" " + " ".join(plain) + " "))
        last = np.searchsorted(ends, [end for end, _ in got])  # the word that ends before this blank
        at = [self.at[k] for _, k in got]
        item = np.concatenate([a[:, 0] for a in at])
        shift = np.repeat(last - SEED + 1, [len(a) for a in at]) - np.concatenate([a[:, 1] for a in at])
        out = []
        for row in self.possible(np.unique(item), plain):
            key, ws = self.items[row]
            # one stretch of the document for the diagonals that lie close together
            shifts = np.unique(shift[item == row])
            for part in np.split(shifts, np.nonzero(np.diff(shifts) > 2 * SLACK)[0] + 1):
                a, b = max(0, int(part[0]) - SLACK), min(len(plain), int(part[-1]) + len(ws) + SLACK)
                if place := holds_passage(ws, plain[a:b], self.own):
                    out.append((key, found[a + place[0]][1], found[a + place[1]][2]))
                    break
        return out


def without_passages(text: str, finder: Finder, share: float = 0.4) -> str:
    """``text`` without the sentences of which at least ``share`` of the words lie in runs of test items' words."""
    found = words(text)
    flat = " " + " ".join([w for w, _, _ in found]) + " "
    ends = np.cumsum([len(w) + 1 for w, _, _ in found])
    covered = np.zeros(len(found), dtype=bool)
    for end, _ in finder.automaton.iter(flat):
        last = int(np.searchsorted(ends, end))
        covered[max(0, last - SEED + 1) : last + 1] = True
    out, start, done = [], 0, 0
    for i in range(len(found)):
        stop = i + 1 == len(found)
        if stop or re.search(r"[.!?]|\n[ \t]*\n", text[found[i][2] : found[i + 1][1]]):
            a, b = found[start][1], len(text) if stop else found[i + 1][1]
            if covered[start : i + 1].mean() >= share:
                out.append(text[done:a] + "\n")
                done = b
            start = i + 1
    return "".join(out) + text[done:]


_FINDERS: dict[str, Finder] = {}


def finder_of(token: str, items: list[tuple[int, list[str], list[str]]]) -> Finder:
    """The finder of a block of items; a worker process builds it once, however many tasks it runs."""
    if token not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[token] = Finder([(k, ws) for k, ws, _ in items], {w for _, _, own in items for w in own})
    return _FINDERS[token]


def item_table(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, words, own, block): the words of each item behind the opening that it shares, and those of them that tell it from others.

    Computed where the rows are: openings meet as digests, words as counts. A block is of about ``BLOCK_WORDS`` words.
    """
    once = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("item_id IS NOT NULL AND t IS NOT NULL").groupBy("item_id").agg(F.max("t").alias("t"))

    @F.pandas_udf("sentences array<array<string>>, openings array<string>, whole string")
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            sentences = [[w for w, _, _ in words(s)] for s in _SENTENCE.split(t) if s.strip()]
            so_far, openings = hashlib.blake2b(digest_size=16), []
            for ws in sentences:
                so_far.update((" ".join(ws) + "\n").encode("utf-8", "replace"))
                openings.append(so_far.hexdigest())
            rows.append((sentences, openings, openings[-1] if openings else ""))
        return pd.DataFrame(rows, columns=["sentences", "openings", "whole"])

    parsed = stage(once.select("item_id", parse("t").alias("p")).select("item_id", "p.*"), "items")
    shared = parsed.select("whole", F.explode("openings").alias("opening")).distinct().groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("opening")
    at = parsed.select("item_id", F.posexplode("openings").alias("at", "opening")).join(shared, "opening").groupBy("item_id").agg((F.max("at") + 1).alias("at"))
    behind = F.slice("sentences", F.coalesce("at", F.lit(0)) + 1, F.greatest(F.size("sentences"), F.lit(1)))
    own_part = stage(parsed.join(at, "item_id", "left").select("item_id", F.flatten(behind).alias("words")).where(F.size("words") >= MIN_WORDS), "items")
    said = own_part.select("item_id", F.explode(F.array_distinct("words")).alias("w"))
    rare = said.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= OWN_ITEMS).select("w")
    own = said.join(rare, "w").groupBy("item_id").agg(F.collect_list("w").alias("own"))
    blocks = -(-(own_part.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS)
    out = own_part.join(own, "item_id", "left").select("item_id", "words", F.coalesce("own", F.array().cast("array<string>")).alias("own"))
    return stage(out.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).cast("int")), "items")


def item_blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, list[str], list[str]]]]:
    """(item, words, own words) of one block after the other; no more than a block is on the driver."""
    table = item_table(items, item_id, item_text)
    for (block,) in table.select("block").distinct().orderBy("block").collect():
        yield [tuple(r) for r in table.where(F.col("block") == block).select("item_id", "words", "own").orderBy("item_id").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, start, end): each item of which a passage occurs in a document, with a place of it.

    The offsets count the characters of the original text. Null, empty and short texts and items give no row; items
    of fewer than MIN_WORDS own words cannot leak; repeated documents of one id give a row once; very long
    texts are scanned whole. Items beyond ``BLOCK_WORDS`` words are scanned in further blocks.
    """
    spark = docs.sparkSession
    once = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= 2 * MIN_WORDS)
    kind = "doc_id long, item_id long, start int, end int"
    out = None
    for block in item_blocks(items, item_id, item_text):
        shared, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], shared=shared, token=token) -> Iterator[pd.DataFrame]:
            finder = finder_of(token, shared.value)
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf.doc_id, pdf.text) for hit in finder.find(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end"])

        part = once.mapInPandas(scan, kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], kind)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("start", "end")).alias("at")).select("doc_id", "item_id", "at.start", "at.end")
