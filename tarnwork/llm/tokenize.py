"""Encoding with a byte-level BPE by a pair occurrence index.

All distinct words of a partition lie one after another in one array of symbols. An index maps each
adjacent pair to the positions where it occurs; the ranks present are taken in ascending order from a
heap, all positions of the rank's pair are merged, and the lists of the pairs that begin or cease are
updated. A merge can only give rise to pairs of a higher rank (checked when the vocabulary is read), so one
ascending pass equals merging each word by itself, lowest rank first and from the left.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.staging import stage

#: Where the vocabulary lies unless told otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The word pattern of this tokenizer, as its vocabulary file prescribes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids a worker remembers between batches; beyond that it forgets, results stay the same.
REMEMBERED_WORDS = 500_000
#: Text that one index is built over: a partition, or so many bytes of a larger one.
HELD_BYTES = 32 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """(id of each byte, {left id * 2**20 + right id: (rank, merged id)})."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merges: dict[int, tuple[int, int]] = {}
    made: dict[int, int] = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        left, right, both = vocab[a], vocab[b], vocab[a + b]
        if made.get(left, -1) >= rank or made.get(right, -1) >= rank or both in made:
            raise ValueError("not a vocabulary in which merges only build on earlier ones")
        made[both] = rank
        merges[left << 20 | right] = (rank, both)
    return [vocab[c] for c in byte_symbols()], merges


class PairIndexEncoder:
    """Encodes batches of texts; see the module docstring."""

    def __init__(self, byte_ids: list[int], merges: dict[int, tuple[int, int]]):
        import regex

        self.byte_ids, self.merges = byte_ids, merges
        self.words = regex.compile(WORD_PATTERN).findall
        self.number = _Numbers()  # of the words met, in order
        self.ids: list[list[int]] = []

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        merges, byte_ids = self.merges, self.byte_ids
        symbols: list[int] = []  # -1 separates words
        starts: list[int] = []
        words = list(words)
        for w in words:
            starts.append(len(symbols))
            symbols.extend([byte_ids[b] for b in w.encode("utf-8", "replace")])
            symbols.append(-1)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        by_rank: dict[int, int] = {}
        heap: list[int] = []

        def note(at: int, a: int, b: int) -> None:
            if a < 0 or b < 0:
                return
            pair = a << 20 | b
            if (got := places.get(pair)) is not None:
                got.append(at)
            elif (m := merges.get(pair)) is not None:
                places[pair] = [at]
                by_rank[m[0]] = pair
                heappush(heap, m[0])

        for i in range(n - 1):
            note(i, symbols[i], symbols[i + 1])
        while heap:
            pair = by_rank.pop(heappop(heap))
            a, b, both = pair >> 20, pair & 0xFFFFF, merges[pair][1]
            for at in sorted(places.pop(pair)):
                nxt = after[at]
                if symbols[at] != a or nxt >= n or symbols[nxt] != b:
                    continue  # a merge before it took one side
                symbols[at] = both
                symbols[nxt] = -2
                end = after[at] = after[nxt]
                if end < n:
                    before[end] = at
                    note(at, both, symbols[end])
                if (prev := before[at]) >= 0:
                    note(prev, symbols[prev], both)
        out = {}
        for w, s in zip(words, starts):
            ids = []
            while symbols[s] != -1:
                ids.append(symbols[s])
                s = after[s]
            out[w] = ids
        return out

    def read(self, texts: Iterable[str | None]) -> list[array]:
        """The numbers of the words of each text."""
        return [array("i", map(self.number.__getitem__, self.words(t))) if t else array("i") for t in texts]

    def learn(self) -> None:
        """Encodes the words that were read since, over one index."""
        new = list(islice(self.number, len(self.ids), None))
        if new:
            got = self.encode_words(new)
            self.ids += [got[w] for w in new]

    def forget(self) -> None:
        if len(self.ids) > REMEMBERED_WORDS:
            self.number, self.ids = _Numbers(), []

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        self.forget()
        read = self.read(texts)
        self.learn()
        return self.ids_of(read)

    def ids_of(self, read: list[array]) -> list[list[int]]:
        return [list(chain.from_iterable(map(self.ids.__getitem__, ns))) for ns in read]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each document, without special tokens.

    Null and empty texts give an empty list. Rows of one id and text are one row; of one
    id with different texts each is kept. An empty table gives an empty table. The strings of special tokens
    are ordinary text. The vocabulary (a fixed file of about 50,000 entries) is read on the
    driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = docs.select(F.col(id_col), F.lit(None).cast("array<int>").alias("ids")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(*shared.value)

        def together(held: list[tuple[pa.Array, list[array]]]) -> Iterator[pa.RecordBatch]:
            encoder.learn()
            for keys, read in held:
                yield pa.RecordBatch.from_arrays([keys, pa.array(encoder.ids_of(read), type=pa.list_(pa.int32()))], names=[id_col, "ids"])
            encoder.forget()

        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0), encoder.read(batch.column(1).to_pylist())))
            size += batch.column(1).nbytes
            if size >= HELD_BYTES:
                yield from together(held)
                held, size = [], 0
        yield from together(held)

    # only ids and digests are shuffled to find what was delivered twice; a text moves only if it was, or if so much was that it cannot be broadcast
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_h"))
    # (written first, so that its size is known when the join is planned)
    twice = stage(given.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_id").alias("_i2"), F.col("_h").alias("_h2")), "delivered_twice")
    same = F.col("_id").eqNullSafe(F.col("_i2")) & (F.col("_h") == F.col("_h2"))
    once = given.join(twice, same, "left_anti").unionByName(given.join(twice, same, "left_semi").dropDuplicates(["_id", "_h"]))
    return once.select(F.col("_id").alias(id_col), F.col("_t").alias(text_col)).mapInArrow(encode, schema)


def decode_ids(ids: Iterable[int], path: str = VOCABULARY) -> str:
    """The text of a list of ids (for round trips)."""
    with open(path, encoding="utf-8") as f:
        back = {i: s for s, i in json.load(f)["model"]["vocab"].items()}
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    return bytes(byte_of[c] for i in ids for c in back[i]).decode("utf-8", "replace")
