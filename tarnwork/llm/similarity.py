"""Groups of records that state the same idea in different words.

What words mean is learned from records that were described several times: terms (words and pairs of words) that occur in
different descriptions of one record belong together. Positive mutual information between descriptions, reduced to
``DIMENSIONS``, gives a vector for each term; terms whose company is no different from everybody's (frames, names) weigh nothing.
Records are then grouped by their final description: cluster-feature trees per partition, merged in a tree of merges;
Ward agglomeration of the leaf summaries; one pass that assigns every record to its nearest centroid.

Every term of at least ``MIN_COMMITS`` records counts, whatever the size of the table; of the matrix of terms only what is not
zero is kept, and workers count it in strips of rows. Bound: ``LEAVES`` leaf summaries, kept by coarser leaves, never by
dropping records.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.staging import stage

MIN_COMMITS = 5  # records that a term must occur in
COUNTING, COUNTED = 512, 10_000  # tasks that count pairs of terms, and records that make a task worth while
STRIP_CELLS = 64_000_000  # cells of the matrix of terms that a worker counts at a time
HELD_TERMS = 10_000_000  # terms of records that a worker holds before it counts them strip by strip
HELD_RECORDS = 500_000  # records after which a worker gives its counts, which are exact up to 2 ** 24
DIMENSIONS = 96
SPECIFIC = 0.5  # divergence of a term's company from everybody's, from which on it counts
LEAF_RADIUS2 = 0.03
LEAVES = 1500
POINTS = 10_000  # wordings that go into one tree
BRANCHING = 32
CUT_DISTANCE2 = 0.25  # squared distance of centroids at which agglomeration stops
FAR2 = 0.6  # squared distance from its centroid at which a record belongs to no group
#: A group is a recurring idea if it comes in at least so many effective wordings per distinct text, up to WORDING_SIZE texts.
WORDINGS_PER_TEXT, WORDING_SIZE = 0.5, 25
TYPICAL = 5
BLOCK = 100

_NAMES = re.compile(r"`[^`]*`|\([^)]*\)")
_TOKEN = re.compile(r"[^\s,.;:!?\"]+")
_PLAIN = re.compile(r"[a-z]+(?:['-][a-z]+)*|[A-Z][a-z]*(?:-[a-z]+)*|[A-Z]{2,}|[&|+*=<>-]{1,2}")


def terms(text: str | None) -> list[str]:
    """Plain words and pairs of them; names of code, paths, figures and what stands in brackets are left out."""
    if not text:
        return []
    words = [w.lower() for w in _TOKEN.findall(_NAMES.sub(" ", text)) if _PLAIN.fullmatch(w)]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


# ---- term vectors


@dataclass
class Space:
    index: dict[str, int]  # of the terms that count
    vectors: np.ndarray  # weighted
    weights: np.ndarray

    def embed(self, text: str | None) -> tuple[np.ndarray, str] | None:
        """The unit vector of a text and the terms it rests on, or None if it has none."""
        at = sorted({i for t in terms(text) if (i := self.index.get(t)) is not None})
        if not at:
            return None
        v = self.vectors[at].sum(axis=0)
        size = float(np.linalg.norm(v))
        return (v / size, " ".join(map(str, at))) if size > 1e-9 else None


def vocabulary(described: DataFrame) -> list[str]:
    """Terms by the number of records they occur in, over all records (id, texts)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for texts in pdf.texts:
                seen.update({t for x in texts for t in terms(x)})
            if len(seen) > 500_000:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})
                seen = Counter()
        yield pd.DataFrame({"term": list(seen), "n": list(seen.values())}).astype({"term": "object", "n": "int64"})

    got = described.mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COMMITS)
    return [r.term for r in got.orderBy(F.desc("n"), "term").collect()]


class Sparse:
    """A symmetric matrix by its cells on and above the diagonal that are not zero, in order of rows."""

    def __init__(self, size: int, row: np.ndarray, col: np.ndarray, value: np.ndarray):
        self.size, self.col, self.value = size, col.astype("int32"), value
        self.first = np.searchsorted(row, np.arange(size + 1))

    def __len__(self) -> int:
        return self.size

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, row, column, value) of ``BLOCK`` rows at a time."""
        for lo in range(0, self.size, BLOCK):
            hi = min(lo + BLOCK, self.size)
            a, b = self.first[lo], self.first[hi]
            yield lo, hi, np.repeat(np.arange(lo, hi), np.diff(self.first[lo : hi + 1])), self.col[a:b], self.value[a:b]

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, q.shape[1]))
        for lo, hi, row, col, value in self.parts():  # a block of rows is filled in at a time
            m = np.zeros((hi - lo, self.size - lo))
            m[row - lo, col - lo] = value
            out[lo:hi] += m @ q[lo:]
            m[np.arange(hi - lo), np.arange(hi - lo)] = 0  # the diagonal counts once
            out[lo:] += m.T @ q[lo:hi]
        return out

    def sums(self, diagonal: bool = True) -> np.ndarray:
        out = np.zeros(self.size)
        for lo, hi, row, col, value in self.parts():
            v = value if diagonal else np.where(row == col, 0, value)
            out[lo:hi] += np.bincount(row - lo, v, hi - lo)
            out += np.bincount(col, np.where(row == col, 0, value), self.size)
        return out


@lru_cache(1024)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _pack(block: int, at: np.ndarray, n: np.ndarray) -> dict:
    return {"block": block, "at": zlib.compress(at.astype("int64").tobytes(), 1), "n": zlib.compress(n.astype("float64").tobytes(), 1)}


def _unpack(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zlib.decompress(at), dtype="int64"), np.frombuffer(zlib.decompress(n), dtype="float64")


class Company:
    """Counts of pairs of terms that stand in different descriptions of one record, by strips of rows that fit in memory."""

    def __init__(self, size: int):
        self.size = size
        self.strip = max(1, STRIP_CELLS // max(1, size) // BLOCK) * BLOCK
        self.one = self.strip >= size
        self.m = np.zeros((size, size), dtype="float32") if self.one else None
        self.held: list[list[np.ndarray]] = []
        self.records = self.terms = 0

    def add(self, sets: list[np.ndarray]) -> bool:
        """Takes the terms of each description of a record; true if it is time to ``flush``."""
        self.records += 1
        if self.one:
            self._count(self.m, 0, sets)
            return self.records >= HELD_RECORDS
        self.held.append(sets)
        self.terms += sum(map(len, sets))
        return self.terms >= HELD_TERMS

    def _count(self, m: np.ndarray, lo: int, sets: list[np.ndarray]) -> None:
        at, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        a, b = np.searchsorted(at, (lo, lo + len(m)))
        if a == b:
            return
        which = np.zeros((len(sets), len(at)), dtype="float32")
        which[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
        i, j = _upper(len(at))
        if b - a < len(at):
            inside = (i >= a) & (i < b)
            i, j = i[inside], j[inside]
        v = (np.multiply.outer(n, n).astype("float32") - which.T @ which)[i, j]
        i, j, v = i[v != 0], j[v != 0], v[v != 0]
        m.reshape(-1)[(at[i] - lo) * self.size + at[j]] += v

    def flush(self) -> Iterator[dict]:
        for lo in range(0, self.size, self.strip) if self.records else ():
            m = self.m
            if not self.one:
                m = np.zeros((min(self.strip, self.size - lo), self.size), dtype="float32")
                for sets in self.held:
                    self._count(m, lo, sets)
            for b in range(0, len(m), BLOCK):
                flat = m[b : b + BLOCK].reshape(-1)
                at = np.nonzero(flat)[0]
                if len(at):
                    yield _pack((lo + b) // BLOCK, at, flat[at])
        if self.one:
            self.m[:] = 0
        self.held, self.records, self.terms = [], 0, 0


def company(described: DataFrame, vocab: list[str]) -> Sparse:
    """How often two terms stand in different descriptions of one record: a matrix of len(vocab) squared.

    A task counts at least ``COUNTED`` records, and at most ``COUNTING`` tasks count, each all that it reads, and give the cells that are not zero, packed by ``BLOCK`` rows; these are
    summed eight to one, so that no task holds more than eight packed blocks, whatever the number of tasks.
    """
    shared = described.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocab)})
    size = len(vocab)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, sums = shared.value, Company(size)
        for pdf in batches:
            for texts in pdf.texts:
                sets = [np.array(sorted({i for t in terms(x) if (i := index.get(t)) is not None}), dtype="int64") for x in texts]
                sets = [s for s in sets if len(s)]
                if len(sets) > 1 and sums.add(sets):
                    for row in sums.flush():
                        yield pd.DataFrame([row])
        for row in sums.flush():
            yield pd.DataFrame([row])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK * size)
        for x, y in zip(pdf["at"], pdf["n"]):
            at, n = _unpack(x, y)
            total[at] += n
        at = np.nonzero(total)[0]
        return pd.DataFrame([_pack(int(key[0]), at, total[at]) | {"part": int(key[1])}])

    parts = min(COUNTING, max(1, -(-described.count() // COUNTED)))
    level = described.coalesce(parts).mapInPandas(count, "block int, at binary, n binary").withColumn("part", F.spark_partition_id())
    while True:
        parts = -(-parts // 8)
        level = level.groupBy("block", (F.col("part") % parts).cast("int").alias("part")).applyInPandas(add, "block int, at binary, n binary, part int")
        if parts == 1:
            break
    got = [(r.block, *_unpack(r["at"], r["n"])) for r in sorted(level.select("block", "at", "n").collect(), key=lambda r: r.block)]
    if not got:
        return Sparse(size, np.zeros(0, "int32"), np.zeros(0, "int32"), np.zeros(0))
    row = np.concatenate([(b * BLOCK + at // size).astype("int32") for b, at, _ in got])
    return Sparse(size, row, np.concatenate([(at % size).astype("int32") for _, at, _ in got]), np.concatenate([n for _, _, n in got]))


def leading(m: np.ndarray | Sparse, d: int, more: int = 24, steps: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """The d largest eigenvalues of a symmetric matrix and their vectors, by subspace iteration from a fixed start."""
    if len(m) <= 2 * (d + more):
        values, vectors = np.linalg.eigh(m @ np.eye(len(m)))
        return values[-d:], vectors[:, -d:]
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((len(m), d + more)))[0]
    for _ in range(steps):
        q = np.linalg.qr(m @ q)[0]
    values, small = np.linalg.eigh(q.T @ (m @ q))
    return values[-d:], q @ small[:, -d:]


def space_of(vocab: list[str], c: Sparse | None) -> Space:
    if not vocab:
        return Space({}, np.zeros((0, 1)), np.zeros(0))
    full, rows = c.sums(), c.sums(diagonal=False)
    overall = np.maximum(rows / max(rows.sum(), 1.0), 1e-12)
    kl = np.zeros(len(vocab))
    for lo, hi, row, col, n in c.parts():
        other = row != col
        row, col, n = row[other], col[other], n[other]
        p, back = n / np.maximum(rows, 1)[row], n / np.maximum(rows, 1)[col]
        kl[lo:hi] += np.bincount(row - lo, p * np.log(p / overall[col]), hi - lo)
        kl += np.bincount(col, back * np.log(back / overall[row]), len(vocab))
    weight = np.clip(kl - SPECIFIC, 0, 1.5)
    keep = np.nonzero(weight > 0)[0]
    if not len(keep):
        return Space({}, np.zeros((0, 1)), np.zeros(0))
    place = np.full(len(vocab), -1, dtype="int32")
    place[keep] = np.arange(len(keep))
    known, total = np.maximum(full, 1e-9), max(full.sum(), 1.0)
    found = []
    for _, _, row, col, n in c.parts():
        pmi = np.log(np.maximum(n * total / known[row] / known[col], 1.0))
        both = (pmi > 0) & (place[row] >= 0) & (place[col] >= 0)
        found.append((place[row[both]], place[col[both]], pmi[both]))
    pmi = Sparse(len(keep), *(np.concatenate(x) for x in zip(*found)))
    values, vectors = leading(pmi, min(DIMENSIONS, len(keep)))
    e = vectors * np.sqrt(np.maximum(values, 0))
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)
    return Space({vocab[i]: k for k, i in enumerate(keep)}, (e * weight[keep][:, None]).astype("float32"), weight[keep])


# ---- cluster features


@dataclass
class _Node:
    leaf: bool
    n: list[float] = field(default_factory=list)
    ls: list[np.ndarray] = field(default_factory=list)
    ss: list[float] = field(default_factory=list)
    children: list["_Node"] = field(default_factory=list)

    def nearest(self, ls: np.ndarray, n: float) -> int:
        c = np.array(self.ls) / np.array(self.n)[:, None]
        return int(((c - ls / n) ** 2).sum(axis=1).argmin())


class CFTree:
    """A cluster-feature tree; entries are (count, sum of vectors, sum of squared norms)."""

    def __init__(self, radius2: float = LEAF_RADIUS2, most: int = LEAVES):
        self.radius2, self.most = radius2, most
        self.root = _Node(True)
        self.size = 0

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        split = self._insert(self.root, n, ls, ss)
        if split:
            self.root = self._parent(split)
        if self.size > self.most:
            self._coarsen()

    def _parent(self, nodes: tuple[_Node, _Node]) -> _Node:
        p = _Node(False)
        for x in nodes:
            p.n.append(sum(x.n))
            p.ls.append(np.sum(x.ls, axis=0))
            p.ss.append(sum(x.ss))
            p.children.append(x)
        return p

    def _insert(self, node: _Node, n: float, ls: np.ndarray, ss: float) -> tuple[_Node, _Node] | None:
        if node.leaf:
            if node.n:
                k = node.nearest(ls, n)
                an, als, ass = node.n[k] + n, node.ls[k] + ls, node.ss[k] + ss
                if ass / an - float(als @ als) / an**2 <= self.radius2:
                    node.n[k], node.ls[k], node.ss[k] = an, als, ass
                    return None
            node.n.append(n)
            node.ls.append(ls)
            node.ss.append(ss)
            self.size += 1
        else:
            k = node.nearest(ls, n)
            split = self._insert(node.children[k], n, ls, ss)
            if split is None:
                node.n[k] += n
                node.ls[k] = node.ls[k] + ls
                node.ss[k] += ss
                return None
            pair = self._parent(split)
            node.n[k : k + 1], node.ls[k : k + 1], node.ss[k : k + 1], node.children[k : k + 1] = pair.n, pair.ls, pair.ss, pair.children
        return self._split(node) if len(node.n) > BRANCHING else None

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        c = np.array(node.ls) / np.array(node.n)[:, None]
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        i, j = divmod(int(d.argmax()), len(c))
        a, b = _Node(node.leaf), _Node(node.leaf)
        for k in range(len(c)):
            to = a if k == i or (k != j and d[k, i] <= d[k, j]) else b
            to.n.append(node.n[k])
            to.ls.append(node.ls[k])
            to.ss.append(node.ss[k])
            if not node.leaf:
                to.children.append(node.children[k])
        return a, b

    def entries(self) -> list[tuple[float, np.ndarray, float]]:
        out, todo = [], [self.root]
        while todo:
            x = todo.pop()
            if x.leaf:
                out += list(zip(x.n, x.ls, x.ss))
            else:
                todo += x.children
        return out

    def _coarsen(self) -> None:
        """Rebuilds from the leaf entries with a larger radius."""
        old = self.entries()
        self.radius2 *= 1.5
        self.root, self.size = _Node(True), 0
        most, self.most = self.most, 1 << 62
        for e in old:
            self.add(*e)
        self.most = most
        if self.size > most:
            self._coarsen()


_CF = "part long, n double, ls array<double>, ss double"


def _entry_rows(part: int, e: list[tuple[float, np.ndarray, float]]) -> pd.DataFrame:
    out = pd.DataFrame({"part": [part] * len(e), "n": [x[0] for x in e], "ls": pd.Series([x[1] for x in e], dtype="object"), "ss": [x[2] for x in e]})
    return out.astype({"part": "int64", "n": "float64", "ss": "float64"})


def leaf_summaries(points: DataFrame) -> list[tuple[float, np.ndarray, float]]:
    """Leaf entries of all points (wording, v array<float>, n long): a tree per ``POINTS`` of them, then trees of trees, eight to one."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, pid = CFTree(), None
        for pdf in batches:
            pid = int(pdf.part.iloc[0]) if pid is None and len(pdf) else pid
            for v, n in zip(pdf.v, pdf.n):
                x = np.asarray(v, dtype="float64")
                tree.add(float(n), x * n, float(x @ x) * n)
        yield _entry_rows(pid or 0, tree.entries())

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = CFTree()
        for n, ls, ss in sorted(zip(pdf.n, pdf.ls, pdf.ss), key=lambda e: (-e[0], e[2], tuple(e[1][:4]))):
            tree.add(n, np.asarray(ls), ss)
        return _entry_rows(int(key[0]), tree.entries())

    parts = max(1, -(-points.count() // POINTS))
    placed = points.repartition(parts, "wording").sortWithinPartitions("wording")
    level = placed.withColumn("part", F.spark_partition_id().cast("long")).select("part", "v", "n").mapInPandas(build, _CF)
    while parts > 1:
        parts = -(-parts // 8)
        level = level.groupBy((F.col("part") % parts).alias("part")).applyInPandas(merge, _CF)
    return [(r.n, np.array(r.ls), r.ss) for r in level.collect()]


def ward(entries: list[tuple[float, np.ndarray, float]]) -> np.ndarray:
    """Centroids of the groups that agglomeration leaves when the next merge would join centroids CUT_DISTANCE2 apart."""
    if not entries:
        return np.zeros((0, 1))
    entries = sorted(entries, key=lambda e: (-e[0], tuple(e[1][:6])))
    n = np.array([e[0] for e in entries])
    c = np.array([e[1] / e[0] for e in entries])
    k = len(n)
    d = np.maximum((c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * c @ c.T, 0)
    cost = d * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(cost, np.inf)
    d[d > CUT_DISTANCE2] = np.inf
    cost[np.isinf(d)] = np.inf
    alive = np.ones(k, dtype=bool)
    while True:
        at = int(cost.argmin())
        i, j = divmod(at, k)
        if not np.isfinite(cost[i, j]):
            return c[alive]
        c[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
        n[i] += n[j]
        alive[j] = False
        cost[j] = cost[:, j] = np.inf
        dist = ((c - c[i]) ** 2).sum(axis=1)
        new = dist * (n * n[i] / (n + n[i]))
        new[~alive | (dist > CUT_DISTANCE2)] = np.inf
        new[i] = np.inf
        cost[i] = cost[:, i] = new


def assign(records: DataFrame, described: DataFrame) -> DataFrame:
    """(record_id, cluster_id, distance, wording, digest, recurring) of all ``records`` (record_id, text).

    ``described`` (record_id, texts) holds several descriptions of each of them. cluster_id is null for a record
    that no group is near: null, empty or blank texts and texts of no telling term. Repeated rows of one id give one row. With no
    records, or none described twice, nothing is grouped. Extra columns are ignored.
    """
    spark = records.sparkSession
    once = stage(records.where("record_id IS NOT NULL").groupBy("record_id").agg(F.max("text").alias("text")), "texts")
    several = stage(described.where("record_id IS NOT NULL AND size(texts) > 0").groupBy("record_id").agg(F.max("texts").alias("texts")).select("texts"), "descriptions")
    vocab = vocabulary(several)
    space = space_of(vocab, company(several, vocab)) if vocab else space_of([], None)
    given = spark.sparkContext.broadcast(space)

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [given.value.embed(t) for t in pdf.text]
            yield pd.DataFrame({"record_id": pdf.record_id, "digest": pdf.digest, "v": [None if g is None else g[0].astype("float32") for g in got], "wording": [None if g is None else g[1] for g in got]})

    embedded = stage(once.select("record_id", "text", F.xxhash64("text").alias("digest")).mapInPandas(embed, "record_id long, digest long, v array<float>, wording string"), "vectors")
    # records of one wording are one point
    points = stage(embedded.where("wording IS NOT NULL").groupBy("wording").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "points")
    centroids = spark.sparkContext.broadcast(ward(leaf_summaries(points)))

    @F.pandas_udf("cluster_id int, distance double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        c = centroids.value
        ids, dist = np.full(len(v), -1), np.full(len(v), np.inf)
        known = np.nonzero(v.notna().to_numpy())[0]
        if len(known) and len(c):
            x = np.stack([np.asarray(v.iloc[i], dtype="float64") for i in known])
            d = np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * x @ c.T, 0)
            best = d.argmin(axis=1)
            at = d[np.arange(len(x)), best]
            ids[known], dist[known] = np.where(at <= FAR2, best, -1), at
        return pd.DataFrame({"cluster_id": pd.Series(ids).where(ids >= 0).astype("Int32"), "distance": np.where(ids >= 0, dist, np.nan)})

    placed = stage(embedded.select("record_id", "digest", "wording", nearest("v").alias("c")).select("record_id", "digest", "wording", "c.cluster_id", F.nanvl("c.distance", F.lit(None).cast("double")).alias("distance")), "assigned")
    return placed.join(F.broadcast(wordings(placed).select("cluster_id", "recurring")), "cluster_id", "left").select("record_id", "cluster_id", "distance", "wording", "digest", F.coalesce("recurring", F.lit(False)).alias("recurring"))


def wordings(placed: DataFrame) -> DataFrame:
    """(cluster_id, size, n_wordings, recurring): at most ``LEAVES`` rows.

    n_wordings is the exponential of the entropy of the wordings of a group's texts. Each text counts once, however many records share
    it, so that copies of one text cannot make a recurring idea look like a frame that is filled in.
    """
    by_text = placed.where("cluster_id IS NOT NULL").groupBy("cluster_id", "wording", "digest").agg(F.count(F.lit(1)).alias("members"))
    by_wording = by_text.groupBy("cluster_id", "wording").agg(F.count(F.lit(1)).alias("n"), F.sum("members").alias("members"))
    sums = by_wording.groupBy("cluster_id").agg(F.sum("members").alias("size"), F.sum("n").alias("texts"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    effective = F.exp(F.log("texts") - F.col("nlogn") / F.col("texts"))
    enough = WORDINGS_PER_TEXT * F.least("texts", F.lit(WORDING_SIZE))
    return sums.select("cluster_id", "size", F.round(effective, 4).alias("n_wordings"), ((effective >= enough) & (F.col("texts") > 1)).alias("recurring"))


def cluster_table(placed: DataFrame) -> DataFrame:
    """(cluster_id, size, n_wordings, recurring, typical): typical holds the ids of the ``TYPICAL`` members nearest to the centroid."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", "record_id"))
    near = placed.where("cluster_id IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= TYPICAL)
    typical = near.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda x: x["record_id"]).alias("typical"))
    return wordings(placed).join(typical, "cluster_id")
