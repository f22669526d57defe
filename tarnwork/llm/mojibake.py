"""Text decoded with a wrong encoding: found and restored through near-twins.

1. Every word with a non-ASCII character is taken with its key: the word stripped of non-ASCII characters
   and the shapes of its neighbours. Words of one key are near-twins.
2. The most frequent word of a key is taken as the clean one and joined with the key's other words. Aligning a
   pair, stretch by stretch, tells which byte routes (written as E, read as D, once or
   repeatedly) turn the clean characters into the garbled ones; routes with enough distinct aligned pairs are learned.
3. Learned routes are inverted on all words. An inversion is accepted if the restored word is far likelier than the
   given one under a character-pair model of the corpus, retrained without the words found garbled so far.
   Replacement characters and C1 controls are evidence by themselves.

All counts are over all records. What is broadcast has a fixed bound: the pair model (hashed into
``MODEL_SIZE`` counters) and the learned routes (a subset of the routes over the codecs below).
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.staging import stage

# Encodings text may have been written in, and read with.
WRITTEN = ["utf-8", "cp1252", "cp1251", "koi8_r", "gbk", "cp932", "euc_jp", "big5", "euc_kr", "mac_roman", "cp437", "cp1250", "iso8859_2", "iso8859_9", "iso8859_15", "cp866", "cp1253", "gb18030"]
READ = ["latin_1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "gbk", "cp932", "big5", "euc_kr", "cp1250", "iso8859_2", "cp1254", "cp866", "cp1253", "gb18030"]

MULTI_BYTE = {"utf-8", "gbk", "cp932", "euc_jp", "big5", "euc_kr", "gb18030"}

MODEL_SIZE = 1 << 18
MIN_SUPPORT = 2  # distinct aligned pairs for a route
# Log odds for an inversion: text that reads as utf-8 under a single-byte codec is evidence by itself, one under a
# multi-byte codec less so, and any bytes read under a single-byte codec.
MARGIN = {"bytes as utf-8": 0.5, "characters as utf-8": 2.0, "other": 3.0}
SALTS = 16
DEEPEST = 3  # times a text may have been garbled
ROUNDS = 3  # of the pair model

WORD = r"[^ \t\r\n]*[^\x00-\x7F][^ \t\r\n]*"
_BLANKS = re.compile(r"[ \t\r\n]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_HARD = re.compile("[�\x80-\x9f]")


# ---- codecs in which undefined bytes pass through as C1 controls, as lenient decoders do


@lru_cache(None)
def _single_byte(codec: str) -> tuple[str, object] | None:
    if codec in MULTI_BYTE:
        return None
    to = []
    for b in range(256):
        try:
            to.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            to.append(chr(b))
    return "".join(to), codecs.charmap_build("".join(to))


def read_as(data: bytes, codec: str) -> str | None:
    try:
        if t := _single_byte(codec):
            return codecs.charmap_decode(data, "strict", t[0])[0]
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


def bytes_of(text: str, codec: str) -> bytes | None:
    try:
        if t := _single_byte(codec):
            return codecs.charmap_encode(text, "strict", t[1])[0]
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def garble(text: str, route: tuple[str, str]) -> str | None:
    data = bytes_of(text, route[0])
    return None if data is None else read_as(data, route[1])


def ungarble(text: str, route: tuple[str, str]) -> str | None:
    """Inverse of ``garble`` on the stretches of ``text`` that the reading codec can hold; None if nothing changes."""
    written, read = route
    whole = bytes_of(text, read)
    if whole is not None:
        got = read_as(whole, written)
        return None if got is None or got == text or "�" in got else got
    parts, now, changed = [], "", False
    for c in [*text, None]:
        if c is not None and bytes_of(c, read) is not None:
            now += c
            continue
        if now and not now.isascii():
            got = read_as(bytes_of(now, read), written)
            if got is None:
                return None
            changed |= got != now
            now = got
        parts.append(now)
        now = ""
        if c is not None:
            parts.append(c)
    return "".join(parts) if changed else None


# ---- the character-pair model


def shape(c: str) -> str:
    if c > "\x7f":
        return c
    return "a" if c.isalpha() else "9" if c.isdigit() else "."


def pairs_of(word: str) -> list[tuple[str, str]]:
    s = ["^", *map(shape, word), "$"]
    return [(x, y) for x, y in zip(s, s[1:]) if x > "\x7f" or y > "\x7f"]


def _slot(x: str, y: str = "") -> int:
    h = 1469598103
    for c in x + "\x00" + y:
        h = (h ^ ord(c)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 32) % MODEL_SIZE


class PairModel:
    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.total = max(float(counts[_slot("#")]), 1.0)
        self.slots: dict[tuple[str, str], float] = {}

    def log_p(self, x: str, y: str) -> float:
        if (got := self.slots.get((x, y))) is None:
            base = (self.n[_slot(y)] + 0.05) / (self.total + 500.0)
            got = float(np.log((self.n[_slot(x, y)] + base) / (self.n[_slot(x)] + 1.0)))
            self.slots[x, y] = got
        return got

    def score(self, word: str) -> float:
        return sum(self.log_p(x, y) for x, y in pairs_of(word))


def model_slots(word: str, weight: float) -> Iterator[tuple[int, float]]:
    for x, y in pairs_of(word):
        yield _slot(x, y), weight
        yield _slot(x), weight
        yield _slot("#"), weight


def inversions(word: str, routes: list[tuple[str, str]]) -> list[tuple[str, str, float]]:
    """(restored word, routes taken, log odds asked for) of every chain of inversions that is possible."""
    seen, level, out = {word}, [(word, "", 0.0)], []
    for depth in range(1, DEEPEST + 1):
        nxt = []
        for w, how, asked in level:
            for written, read in routes:
                c = ungarble(w, (written, read))
                if c is None or c in seen:
                    continue
                seen.add(c)
                kind = "other" if written != "utf-8" else "characters as utf-8" if read in MULTI_BYTE else "bytes as utf-8"
                step = (c, f"{read}<{written}" + (f",{how}" if how else ""), max(asked, MARGIN[kind]))
                out.append(step)
                if written == "utf-8":  # repeated garbling is of programs that write utf-8; what came first may be anything
                    nxt.append(step)
        level = nxt
    return out


def choose(word: str, found: list, model: PairModel) -> tuple[str, str] | None:
    """(restored word, routes taken) of the likeliest inversion that is as much likelier than the word as it must be."""
    given = model.score(word)
    best, best_gain = None, 0.0
    for c, how, asked in found:
        gain = model.score(c) - given - asked
        if gain > best_gain:
            best, best_gain = (c, how), gain
    return best


# ---- DataFrame stages


def words_of(records: DataFrame, text: str) -> DataFrame:
    """(origin, record_id, w, key): each distinct word with a non-ASCII character of each record, with its twin key.

    The key is the word without non-ASCII characters, digits as 9, and the letter shapes of the words beside it.
    """
    lines = records.select("origin", "record_id", F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    return (
        lines.select("origin", "record_id", F.explode(F.split("line", r"[ \t\r]+")).alias("w"), F.regexp_replace(F.regexp_replace("line", r"[^\x00-\x7F]+", ""), r"[^A-Za-z ]+", "").alias("stripped"))
        .where(F.col("w").rlike(r"[^\x00-\x7F]"))
        .withColumn("w", F.regexp_replace("w", r"[0-9]+", "9"))
    )


def twin_key(word: Column, stripped: Column) -> Column:
    own = F.regexp_replace(word, r"[^\x00-\x7F]+", "")
    # words of the stripped line that look like plain words: names differ between twins
    plain = F.array_join(F.slice(F.filter(F.split(stripped, " +"), lambda x: x.rlike("^[a-z]{2,9}$")), 1, 3), " ")
    return F.concat_ws("|", F.when(F.length(own) >= 3, own).otherwise(F.concat_ws("~", own, plain)))


def learn_routes(words: DataFrame) -> list[tuple[str, str, int]]:
    """(written, read, support) of the routes that aligned twins show."""
    per_word = words.withColumn("key", twin_key(F.col("w"), F.col("stripped"))).where(F.length("key") >= 3).groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"))
    top = per_word.groupBy("key").agg(F.max_by("w", F.struct("n", F.negate(F.length("w")), "w")).alias("clean"), F.max("n").alias("n_clean")).where("n_clean >= 3")
    # short words share one key with many others: it is met under salts
    salted = per_word.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(SALTS)).cast("int"))
    met = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    twins = salted.join(met, ["key", "salt"]).where("w <> clean").select("clean", "w").distinct()

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [(e, d) for e in WRITTEN for d in READ if e != d]
        for pdf in batches:
            out = set()
            for clean, w in zip(pdf.clean, pdf.w):
                a, b = _RUN.findall(clean), _RUN.findall(w)
                pieces = list(zip(a, b)) if len(a) == len(b) else [(clean, w)]
                for x, y in dict.fromkeys(pieces):
                    if x == y:
                        continue
                    fits = []
                    for r in every:
                        t, deep = x, 0
                        while t is not None and deep < DEEPEST and len(t) <= len(y):
                            t, deep = garble(t, r), deep + 1
                            if t == y:
                                fits.append(f"{r[0]}>{r[1]}")
                                break
                            if r[0] != "utf-8":
                                break
                    if fits:
                        out.add((x, y, "|".join(fits)))
            yield pd.DataFrame(sorted(out), columns=["x", "y", "fits"])

    # pairs with the same fitting routes are one row: the driver gets sets of routes with counts, never pairs
    got = twins.mapInPandas(align, "x string, y string, fits string").distinct().groupBy("fits").agg(F.count(F.lit(1)).alias("n")).collect()
    left = {r.fits: (set(r.fits.split("|")), r.n) for r in got}
    chosen = []
    while left:
        support: dict[str, int] = {}
        for routes, n in left.values():
            for r in routes:
                support[r] = support.get(r, 0) + n
        best = max(support, key=lambda r: (support[r], [-WRITTEN.index(r.split(">")[0]), -READ.index(r.split(">")[1])]))
        if support[best] < MIN_SUPPORT:
            break
        chosen.append((*best.split(">"), support[best]))
        left = {k: v for k, v in left.items() if best not in v[0]}
    return chosen


def fit_model(distinct: DataFrame) -> np.ndarray:
    """Pair counts of (w, n), summed per partition before they are gathered; at most ``MODEL_SIZE`` counters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, float] = {}
        for pdf in batches:
            for w, n in zip(pdf.w, pdf.n):
                for s, k in model_slots(w, float(n)):
                    sums[s] = sums.get(s, 0.0) + k
        yield pd.DataFrame({"slot": list(sums), "n": list(sums.values())}).astype({"slot": "int32", "n": "float64"})

    out = np.zeros(MODEL_SIZE)
    rows = distinct.mapInPandas(count, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[rows.slot.to_numpy()] = rows.n.to_numpy()
    return out


def judge_words(words: DataFrame) -> DataFrame:
    """(w, restored, route) of the distinct words found garbled; restored is null where it cannot be told."""
    spark = words.sparkSession
    routes = learn_routes(words)
    table = [(a, b) for a, b, _ in routes]

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(found=[[{"c": c, "how": h, "asked": m} for c, h, m in inversions(w, table)] for w in pdf.w])

    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    distinct = stage(counted.mapInPandas(invert, "w string, n long, found array<struct<c:string,how:string,asked:double>>"), "nonascii_words")
    judged = distinct.withColumn("restored", F.lit(None).cast("string")).withColumn("route", F.lit(None).cast("string"))
    for _ in range(ROUNDS):
        model = spark.sparkContext.broadcast(fit_model(judged.where("route IS NULL").select("w", "n")))

        def judge(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            m = PairModel(model.value)
            for pdf in batches:
                got = [choose(w, [(f["c"], f["how"], f["asked"]) for f in fs], m) for w, fs in zip(pdf.w, pdf.found)]
                hard = [bool(_HARD.search(w)) for w in pdf.w]
                yield pd.DataFrame({
                    "w": pdf.w, "n": pdf.n,
                    "restored": [g[0] if g else None for g in got],
                    "route": [g[1] if g else "unknown" if h else None for g, h in zip(got, hard)],
                })

        judged = stage(distinct.mapInPandas(judge, "w string, n long, restored string, route string"), "judged_words")
    return judged.where("route IS NOT NULL").select("w", "restored", "route")


def find_garbled(records: DataFrame, text: str) -> DataFrame:
    """(origin, record_id): records with at least one garbled stretch, once each.

    ``records`` has origin, record_id and ``text``. Null and empty texts are no case; repeated rows
    are one; an empty table gives an empty result; extra columns are ignored. A word on its own may be a
    third of all rows: judged words are joined under ``SALTS`` salts.
    """
    words = stage(words_of(records, text), "record_words")
    bad = judge_words(words).select("w", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = words.select("origin", "record_id", "w").distinct().withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    return mine.join(bad, ["w", "salt"], "left_semi").select("origin", "record_id").distinct()


def restore_text(records: DataFrame, text: str) -> DataFrame:
    """(origin, record_id, restored, complete): the text of each garbled record with its garbled words put right.

    ``complete`` is false if some garbled word could not be restored; it then stands as it was. Digits of a garbled word
    are those of the record.
    """
    words = stage(words_of(records, text), "record_words")
    judged = judge_words(words)
    bad = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = words.select("origin", "record_id", "w").distinct().withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    fixes = mine.join(bad, ["w", "salt"]).groupBy("origin", "record_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "route"))).alias("routes"))

    @F.pandas_udf("restored string, complete boolean")
    def put_right(text: pd.Series, routes: pd.Series) -> pd.DataFrame:
        rows = []
        for t, rs in zip(text, routes):
            rs, whole, out = dict(rs), True, []
            for part in re.split(r"([ \t\r\n]+)", t):
                route = rs.get(re.sub(r"[0-9]+", "9", part))
                if route is None:
                    out.append(part)
                    continue
                w = part
                if route == "unknown":
                    whole = False
                else:
                    for step in reversed(route.split(",")):
                        read, written = step.split("<")
                        w = ungarble(w, (written, read)) or w
                out.append(w)
            rows.append(("".join(out), whole))
        return pd.DataFrame(rows, columns=["restored", "complete"])

    once = records.select("origin", "record_id", F.col(text).alias("_text")).withColumn("_h", F.xxhash64("_text")).dropDuplicates(["origin", "record_id", "_h"]).drop("_h")
    return once.join(fixes, ["origin", "record_id"]).select("origin", "record_id", put_right("_text", "routes").alias("r")).select("origin", "record_id", "r.restored", "r.complete")
