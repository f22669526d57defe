"""Dense vectors: cosine, norms, and a deterministic hashed embedding for use without a model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0; null where a vector is null."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(n == 0, F.lit(0.0))


def hashed_embedding(texts: list[str], dims: int = 128) -> np.ndarray:
    """Signed hashed counts of words and character trigrams, of length 1 (0 for an empty text)."""
    out = np.zeros((len(texts), dims), dtype="float32")
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for g in [*low.split(), *(low[k : k + 3] for k in range(len(low) - 2))]:
            h = zlib.crc32(g.encode("utf-8", "replace"))
            out[i, h % dims] += 1.0 if h & 0x80000000 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def embed(df: DataFrame, text: str, output: str = "embedding", encoder: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """Adds ``output`` (array<float>) by an encoder of lists of texts; null counts as an empty text."""

    @F.pandas_udf("array<float>")
    def vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(encoder(["" if x is None else x for x in s])))

    return df.withColumn(output, vec(F.col(text)))


def embed_with_cache(df: DataFrame, text: str, cache: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, rows to add to the cache). The cache (key, embedding) is keyed by a digest of the text."""
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = df.withColumn("key", key)
    missing = keyed.select("key", text).dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = embed(missing, text, "embedding", encoder).select("key", "embedding")
    return keyed.join(cache.unionByName(fresh), "key", "left").drop("key"), fresh


def fuse(*vectors: Column) -> Column:
    """Vectors end to end; null if one of them is."""
    return F.concat(*vectors)
