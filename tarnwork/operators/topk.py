"""Exact search of a stated query set against all rows, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.config import DEFAULTS
from tarnwork.functions.text import ascii_tokens

#: Queries that are broadcast at once; more are searched in further blocks.
QUERY_BLOCK = 20_000
K1, B, EPSILON = 1.5, 0.75, 0.25  # of BM25
DIGITS = 9  # scores are ranked after rounding, so that ties do not hang on the order of sums


def _blocks(queries: DataFrame, order: str, size: int) -> Iterator[pd.DataFrame]:
    """The query set in blocks of at most ``size`` rows, read one after the other by the order of its id."""
    last = None
    while True:
        part = queries if last is None else queries.where(F.col(order) > F.lit(last))
        pdf = part.orderBy(order).limit(size).toPandas()
        if pdf.empty:
            return
        yield pdf
        if len(pdf) < size:
            return
        last = pdf[order].iloc[-1].item() if hasattr(pdf[order].iloc[-1], "item") else pdf[order].iloc[-1]


def _group(group: str, side: str):
    """The group as text; a null one equals no group of the other side."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(side))


def _rank(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "d_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _local_top(q_ids: np.ndarray, d_ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray, k: int) -> pd.DataFrame:
    """The best k allowed documents of each query; scores and allowed are (queries, documents)."""
    rows = []
    scores = np.where(allowed, np.round(scores, DIGITS), -np.inf)
    for i in range(len(q_ids)):
        s = scores[i]
        if len(s) > k:  # everything at or above the k-th score, ties included
            least = np.partition(s, len(s) - k)[len(s) - k]
            at = np.nonzero((s >= least) & np.isfinite(s))[0]
        else:
            at = np.nonzero(np.isfinite(s))[0]
        best = at[np.lexsort((d_ids[at], -s[at]))][:k]
        rows.append(pd.DataFrame({"q_id": q_ids[i], "d_id": d_ids[best], "score": s[best]}))
    return pd.concat(rows) if rows else pd.DataFrame({"q_id": [], "d_id": [], "score": []})


def cosine_topk(corpus: DataFrame, queries: DataFrame, *, id: str, vector: str, group: str, k: int = DEFAULTS.top_k, other_group_only: bool = DEFAULTS.ignore_same_repository) -> DataFrame:
    """(q_id, d_id, score, rank): the k rows of highest cosine for each query, of other groups than its own.

    Ranked by score to nine digits, then id. Zero and null vectors have cosine 0; a null group differs from every group;
    a query does not find itself. Repeated corpus rows of an id are one.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col(id).cast("long").alias("d_id"), F.col(vector).alias("v"), _group(group, "d").alias("g")).dropDuplicates(["d_id"])
    asked = queries.select(F.col(id).cast("long").alias("q_id"), F.col(vector).alias("v"), _group(group, "q").alias("g")).dropDuplicates(["q_id"])
    out = None
    for block in _blocks(asked, "q_id", QUERY_BLOCK):
        size = max([len(x) for x in block.v if x is not None], default=1)
        q = np.array([np.zeros(size) if x is None else np.asarray(x, dtype="float64") for x in block.v])
        n = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((block.q_id.to_numpy(), q / np.where(n > 0, n, 1), block.g.to_numpy(dtype=object)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, g = shared.value
            for pdf in batches:
                d = np.array([np.zeros(q.shape[1]) if x is None else np.asarray(x, dtype="float64") for x in pdf.v]).reshape(len(pdf), q.shape[1])
                size = np.linalg.norm(d, axis=1, keepdims=True)
                scores = q @ (d / np.where(size > 0, size, 1)).T
                d_ids, dg = pdf.d_id.to_numpy(), pdf.g.to_numpy(dtype=object)
                allowed = d_ids[None] != ids[:, None]
                if other_group_only:
                    allowed &= dg[None] != g[:, None]
                yield _local_top(ids, d_ids, scores, allowed, k)

        part = _rank(docs.mapInPandas(search, "q_id long, d_id long, score double"), k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _rank(docs.select(F.col("d_id").alias("q_id"), "d_id", F.lit(0.0).alias("score")).limit(0), k)


def bm25_topk(corpus: DataFrame, queries: DataFrame, *, id: str, text: str, group: str, k: int = DEFAULTS.top_k, other_group_only: bool = DEFAULTS.ignore_same_repository, tokens=ascii_tokens) -> DataFrame:
    """(q_id, d_id, score, rank): Okapi BM25 of each query text against all texts, of other groups than the query's own.

    Statistics are over the whole corpus. A word in more than half of the texts gets ``EPSILON`` times the mean idf; a word
    repeated in the query counts again. All rows rank, also those of score 0 (by id); a query without a word has no
    result; a null text is an empty one; a null group differs from every group; repeated rows of an id are one.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col(id).cast("long").alias("d_id"), _group(group, "d").alias("g"), tokens(F.col(text)).alias("t")).dropDuplicates(["d_id"])
    df = docs.select(F.explode(F.array_distinct("t")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = docs.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    idf = F.log(F.lit(float(n or 0)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idfs = df.withColumn("idf", idf)
    mean = idfs.agg(F.avg("idf")).first()[0] or 0.0
    idfs = idfs.withColumn("idf", F.when(F.col("idf") < 0, F.lit(EPSILON * mean)).otherwise(F.col("idf"))).select("w", "idf")
    asked = queries.select(F.col(id).cast("long").alias("q_id"), _group(group, "q").alias("g"), tokens(F.col(text)).alias("t")).dropDuplicates(["q_id"]).where(F.size("t") > 0)
    out = None
    for block in _blocks(asked, "q_id", QUERY_BLOCK // 10):
        wanted = sorted({w for ws in block.t for w in ws})  # bounded by the block
        known = {r.w: r.idf for r in idfs.join(F.broadcast(spark.createDataFrame([(w,) for w in wanted], "w string")), "w").collect()}
        shared = spark.sparkContext.broadcast((block.q_id.to_numpy(), [[w for w in ws if w in known] for ws in block.t], block.g.to_numpy(dtype=object), known, avgdl or 1.0))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked_words, g, known, avgdl = shared.value
            for pdf in batches:
                d_ids, dg = pdf.d_id.to_numpy(), pdf.g.to_numpy(dtype=object)
                size = np.array([len(t) for t in pdf.t], dtype="float64")
                weight = K1 * (1 - B + B * size / avgdl)
                at: dict[str, list[int]] = {}
                tf: dict[str, list[float]] = {}
                for i, ws in enumerate(pdf.t):
                    count: dict[str, int] = {}
                    for w in ws:
                        if w in known:
                            count[w] = count.get(w, 0) + 1
                    for w, c in count.items():
                        at.setdefault(w, []).append(i)
                        tf.setdefault(w, []).append(float(c))
                part = {w: (np.array(a), known[w] * np.array(tf[w]) * (K1 + 1) / (np.array(tf[w]) + weight[a])) for w, a in at.items()}
                scores = np.zeros((len(ids), len(pdf)))
                for i, ws in enumerate(asked_words):
                    for w in ws:
                        if w in part:
                            a, s = part[w]
                            scores[i, a] += s
                allowed = d_ids[None] != ids[:, None]
                if other_group_only:
                    allowed &= dg[None] != g[:, None]
                yield _local_top(ids, d_ids, scores, allowed, k)

        part = _rank(docs.mapInPandas(search, "q_id long, d_id long, score double"), k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _rank(docs.select(F.col("d_id").alias("q_id"), "d_id", F.lit(0.0).alias("score")).limit(0), k)


def topk_unique(found: DataFrame, *, keys: list[str], k: int = DEFAULTS.few_shot) -> DataFrame:
    """Of each query's hits the best of every key, and of these the k best, ranked anew."""
    first = Window.partitionBy("q_id", *keys).orderBy(F.desc("score"), "d_id")
    once = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "rank")
    return _rank(once, k)


def fewshot_order(found: DataFrame, k: int = DEFAULTS.few_shot) -> DataFrame:
    """The k best hits of each query in ascending order of score, with their place from 1 (ties keep ascending id)."""
    return found.where(F.col("rank") <= k).withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy("score", "d_id")))
