"""k-means, PCA, Ward, density clustering and model selection over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.config import DEFAULTS

#: Rows that the quadratic methods (Ward, density) take; more are refused, not sampled.
QUADRATIC_ROWS = 5_000


def _with_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, output: str = "cluster", starts: int = 1) -> DataFrame:
    """Adds the cluster of each row, of the best of ``starts`` runs by cost; deterministic for a fixed order of input partitions."""
    v = _with_vector(df, vector)
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol=output).fit(v) for i in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(v).drop("_v")


def minibatch_kmeans(df: DataFrame, key: str, vector: str, k: int, batches: int = 20, passes: int = 3, seed: int = 42, output: str = "cluster") -> DataFrame:
    """Adds the cluster of each row by centres that move with one batch of rows after the other.

    A batch is the rows whose hash of ``key`` falls into its share, so that a pass takes every row once; a batch's sums are reduced per
    partition before k rows reach the driver. A centre moves by its batch mean, weighted by the rows it has met.
    """
    once = df.select(F.col(vector).alias("_x"), F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(batches)).alias("_b"))
    first = once.orderBy(F.xxhash64("_x", F.lit(seed)), "_x").limit(k).collect()
    centres = np.array([r["_x"] for r in first], dtype="float64")
    met = np.zeros(len(centres))
    spark = df.sparkSession

    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)

    for step in range(passes * batches if len(centres) else 0):
        shared = spark.sparkContext.broadcast(centres)

        def sums(parts, shared=shared):
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c))
            for pdf in parts:
                if len(pdf):
                    x = np.stack([np.asarray(v, dtype="float64") for v in pdf["_x"]])
                    at = nearest(x, c)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(c))
            yield pd.DataFrame({"c": np.arange(len(c)), "n": n, "s": list(total)})

        got = once.where(F.col("_b") == step % batches).select("_x").mapInPandas(sums, "c int, n double, s array<double>").collect()
        n, total = np.zeros(len(centres)), np.zeros_like(centres)
        for r in got:
            n[r.c] += r.n
            total[r.c] += np.array(r.s)
        met += n
        moved = n > 0
        rate = n[moved] / met[moved]
        centres[moved] += rate[:, None] * (total[moved] / n[moved][:, None] - centres[moved])
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cluster(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack([np.asarray(x, dtype="float64") for x in v]), shared.value).astype("int32"))

    return df.withColumn(output, cluster(F.col(vector)))


def pca(df: DataFrame, vector: str, dims: int, output: str = "reduced") -> DataFrame:
    """Centred principal components (the library's own transform does not centre)."""
    size = df.select(F.max(F.size(vector))).first()[0]
    mean = [r or 0.0 for r in df.select(*[F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(size)]).first()]
    centred = df.withColumn("_c", F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m))
    v = _with_vector(centred, "_c")
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(output, vector_to_array("_p")).drop("_v", "_c", "_p")


def _bounded(df: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    pdf = df.select(key, vector).orderBy(key).limit(QUADRATIC_ROWS + 1).toPandas()
    if len(pdf) > QUADRATIC_ROWS:
        raise ValueError(f"a quadratic method takes {QUADRATIC_ROWS} rows at most; reduce the rows to summaries first")
    x = np.array([np.asarray(v, dtype="float64") for v in pdf[vector]]) if len(pdf) else np.zeros((0, 1))
    return pdf[key].to_numpy(), x


def squared_distances(x: np.ndarray) -> np.ndarray:
    s = (x**2).sum(axis=1)
    return np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0)


def ward_merges(x: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (kept, joined) of Ward agglomeration down to one cluster, in order."""
    n = len(x)
    c, size, alive = x.copy(), np.ones(n), np.ones(n, dtype=bool)
    cost = squared_distances(c) / 2
    np.fill_diagonal(cost, np.inf)
    # the cheapest partner of each cluster is kept, so that a merge costs a row and not the whole matrix
    partner = cost.argmin(axis=1) if n else np.zeros(0, dtype=int)
    best = cost[np.arange(n), partner]
    merges = []
    for _ in range(max(0, n - 1)):
        i = int(best.argmin())
        i, j = sorted((i, int(partner[i])))
        merges.append((i, j))
        c[i] = (c[i] * size[i] + c[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        cost[j] = cost[:, j] = np.inf
        best[j] = np.inf
        d = ((c - c[i]) ** 2).sum(axis=1) * size * size[i] / (size + size[i])
        d[~alive] = np.inf
        d[i] = np.inf
        cost[i] = cost[:, i] = d
        stale = alive & ((partner == i) | (partner == j))
        stale[i] = True
        partner[stale] = cost[stale].argmin(axis=1)
        best[stale] = cost[stale, partner[stale]]
        nearer = alive & ((d < best) | ((d == best) & (i < partner)))
        partner[nearer], best[nearer] = i, d[nearer]
    return merges


def cut_merges(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Labels of k clusters, by first member."""
    member = np.arange(n)
    for i, j in merges[: max(0, n - k)]:
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1] if n else member


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration to k clusters; labels by first member."""
    return cut_merges(ward_merges(x), len(x), k)


def density_labels(x: np.ndarray, min_cluster_size: int = 5, min_samples: int = 5) -> np.ndarray:
    """Clusters of a mutual-reachability tree chosen by excess of mass; -1 is noise."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    d = np.sqrt(squared_distances(x))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    # minimum spanning tree
    inside, best, parent, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    now = 0
    for _ in range(n - 1):
        inside[now] = True
        closer = ~inside & (reach[now] < best)
        best[closer], parent[closer] = reach[now][closer], now
        now = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[now], parent[now], now))
    edges.sort(key=lambda e: e[0])
    # single-linkage tree: node n + i joins two nodes at a distance
    up = list(range(n))
    top = {i: i for i in range(n)}

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    kids, size, at = {}, {i: 1 for i in range(n)}, {}
    for i, (w, a, b) in enumerate(edges):
        ra, rb = find(a), find(b)
        node = n + i
        kids[node], at[node] = (top[ra], top[rb]), w
        size[node] = size[top[ra]] + size[top[rb]]
        up[rb] = ra
        top[ra] = node
    leaves = lambda node: [node] if node < n else [y for c in kids[node] for y in leaves(c)] if size[node] < 900 else _leaves(node, kids, n)
    # condensed clusters: (node, birth); children of at least min_cluster_size split, others fall out
    stability: dict[int, float] = {}
    split: dict[int, list[int]] = {}
    root = n + len(edges) - 1
    todo = [(root, 0.0)]
    order = []
    while todo:
        start, birth = todo.pop()
        order.append(start)
        s, node = 0.0, start
        split[start] = []
        while node >= n:
            lam = 1 / max(at[node], 1e-12)
            a, b = kids[node]
            big = [c for c in (a, b) if size[c] >= min_cluster_size]
            if len(big) == 2:
                s += (lam - birth) * size[node]
                split[start] = [a, b]
                todo += [(a, lam), (b, lam)]
                break
            s += (lam - birth) * (size[node] - (size[big[0]] if big else 0))
            if not big:
                break
            node = big[0]
        stability[start] = s
    chosen: dict[int, bool] = {}
    for start in reversed(order):
        below = sum(stability[c] for c in split[start])
        if start != root and (not split[start] or stability[start] >= below):
            chosen[start] = True
        else:
            chosen[start] = False
            stability[start] = below
    labels, k = np.full(n, -1), 0
    todo = [root]
    while todo:
        c = todo.pop()
        if chosen[c]:
            labels[leaves(c)] = k
            k += 1
        else:
            todo += split[c]
    return labels


def _leaves(node: int, kids: dict[int, tuple[int, int]], n: int) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x < n:
            out.append(x)
        else:
            todo += kids[x]
    return out


def _labelled(df: DataFrame, key: str, keys: np.ndarray, labels: np.ndarray, output: str) -> DataFrame:
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = pd.DataFrame({key: keys, output: labels.astype("int32")})
    return df.join(F.broadcast(spark.createDataFrame(rows, f"{key} {kind}, {output} int")), key, "left")


def ward(df: DataFrame, key: str, vector: str, k: int, output: str = "cluster") -> DataFrame:
    keys, x = _bounded(df, key, vector)
    return _labelled(df, key, keys, ward_labels(x, k), output)


def density(df: DataFrame, key: str, vector: str, min_cluster_size: int = 5, min_samples: int = 5, output: str = "cluster") -> DataFrame:
    keys, x = _bounded(df, key, vector)
    return _labelled(df, key, keys, density_labels(x, min_cluster_size, min_samples), output)


def silhouette(x: np.ndarray, labels: np.ndarray, distances: np.ndarray | None = None) -> float:
    """Mean Euclidean silhouette; -1 where it is not defined."""
    if not 2 <= len(set(labels)) < len(x):
        return -1.0
    d = np.sqrt(squared_distances(x)) if distances is None else distances
    names, at = np.unique(labels, return_inverse=True)
    member = np.eye(len(names))[at]
    size = member.sum(axis=0)
    sums = d @ member
    own = sums[np.arange(len(x)), at] / np.maximum(size[at] - 1, 1)
    other = sums / size
    other[np.arange(len(x)), at] = np.inf
    other = other.min(axis=1)
    top = np.maximum(own, other)
    s = np.where((size[at] > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0)
    return float(s.mean())


def choose_k(df: DataFrame, key: str, vector: str, ks: range = range(DEFAULTS.ward_k[0], DEFAULTS.ward_k[1] + 1)) -> DataFrame:
    """(k, silhouette) of Ward cuts; the first largest is the choice."""
    _, x = _bounded(df, key, vector)
    merges, distances = ward_merges(x), np.sqrt(squared_distances(x))
    rows = [(k, silhouette(x, cut_merges(merges, len(x), k), distances) if k < len(x) else -1.0) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def noise_share(df: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, noise rows, share of noise."""
    return df.agg(F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("clusters"), F.count_if(F.col(cluster) == -1).alias("noise"), F.round(F.avg((F.col(cluster) == -1).cast("double")), 6).alias("share"))


def inertia(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, size, inertia): squared distances to the centroid, from sums alone: Σ|v|² − |Σv|² / n."""
    v = df.select(cluster, F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    own = v.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.sum(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)).alias("_ss"))
    total = v.where("_v IS NOT NULL").groupBy(cluster).agg(Summarizer.sum(array_to_vector(F.col("_v"))).alias("_t")).select(cluster, vector_to_array("_t").alias("_s"))
    sums = total.select(cluster, F.aggregate("_s", F.lit(0.0), lambda s, x: s + x * x).alias("_ls2"))
    return own.join(sums, cluster).select(cluster, "size", (F.col("_ss") - F.col("_ls2") / F.col("size")).alias("inertia"))
