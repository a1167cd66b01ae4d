"""Exact nearest neighbours of many queries at once.

Vectors are dealt to clusters around centroids taken from a bounded sample; a cluster is known by its centroid, its radius and
its size. For a query the clusters' largest possible distances, nearest first, bound the distance of its k-th neighbour
as soon as k vectors are covered, and every cluster whose least possible distance lies beyond that bound is left out. So
pruning never loses a neighbour, whatever the sample.

What remains are pairs of blocks: a cluster of many vectors is cut into blocks of at most about BLOCK, its queries as
well, and each pair of blocks is one matrix of distances, of which a query keeps k. A query's results are merged from
at most k rows a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import kept

#: Vectors of a block; centroids, which is also the size of the sample they are taken from.
BLOCK, CENTROIDS = 2048, 64
#: Distances count to so many digits; vectors as near as that are ordered by key.
DIGITS = 9


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of y, summed from differences, so equal vectors have 0."""
    return np.stack([((y - row) ** 2).sum(1) for row in x]) if len(x) else np.zeros((0, len(y)))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _candidates(asks: np.ndarray, vs: np.ndarray, k: int) -> np.ndarray:
    """For each row of asks which rows of vs may be among its k nearest: by products, with room for their rounding."""
    if len(vs) <= k:
        return np.ones((len(asks), len(vs)), bool)
    a2, v2 = (asks * asks).sum(1), (vs * vs).sum(1)
    with np.errstate(invalid="ignore"):
        about = a2[:, None] + v2 - 2 * (asks @ vs.T)
    if not np.isfinite(about).all():
        return np.ones(about.shape, bool)
    room = 4 * 10.0**-DIGITS + 1e-14 * vs.shape[1] * (a2 + v2.max())
    return about <= (np.partition(about, k - 1, axis=1)[:, k - 1] + room)[:, None]


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = 12, cutoff: float | None = None, key: str = "vec_id", id: str = "id", centroids: int = CENTROIDS, block: int = BLOCK) -> DataFrame:
    """id, key, distance and rank of the k vectors (key, embedding) nearest to each query (id, embedding).

    Distances are squared; ties go by key. cutoff leaves out what is farther away. Null vectors on either side have no
    neighbours; keys and ids should be unique.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col(id).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    key_kind, id_kind = rows.schema["key"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()
    out = f"id {id_kind}, key {key_kind}, distance double"
    named = lambda df: df.select(F.col("id").alias(id), F.col("key").alias(key), "distance", "rank")
    # The sample is the vectors of the smallest hashes: a bounded number of rows, the same in every run.
    sample = [r[0] for r in rows.orderBy(F.xxhash64("key"), "key").limit(centroids).select("embedding").collect()]
    if not sample:
        return named(spark.createDataFrame([], out).withColumn("rank", F.lit(0).cast("long")))
    center = np.array(sample)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(center, _matrix(pdf["embedding"]))
                at = d.argmin(0)
                yield pdf.assign(cluster=at, away=np.sqrt(d[at, np.arange(len(pdf))]))

    dealt = kept(rows.mapInPandas(deal, f"key {key_kind}, embedding array<double>, cluster int, away double"))
    known = dealt.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()  # one row a centroid
    cluster = np.array([r["cluster"] for r in known])
    radius, size = np.array([r["radius"] for r in known]), np.array([r["n"] for r in known])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = np.sqrt(_distances(_matrix(pdf["embedding"]), center[cluster]))
            # A little slack for the rounding of distances and of the square roots.
            low, high = np.maximum(d - radius, 0) * (1 - 1e-9) - 1e-6, (d + radius) * (1 + 1e-9) + 1e-6
            if cutoff is not None:
                high = np.minimum(high, np.sqrt(cutoff) + 1e-6)
            order = np.argsort(d + radius, axis=1)
            covered = np.cumsum(size[order], axis=1) >= k
            last = np.where(covered.any(1), covered.argmax(1), len(cluster) - 1)
            bound = np.where(covered.any(1) | (cutoff is not None), np.take_along_axis(high, np.take_along_axis(order, last[:, None], 1), 1)[:, 0], np.inf)
            i, c = np.nonzero(low <= bound[:, None])
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "embedding": list(pdf["embedding"].to_numpy()[i]), "cluster": cluster[c]})

    cuts = [(c, -(-n // block)) for c, n in zip(cluster.tolist(), size.tolist(), strict=True)]
    blocks = F.element_at(F.create_map(*[F.lit(x) for pair in cuts for x in pair]), F.col("cluster").cast("long"))
    right = dealt.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    # Queries of a cluster are dealt to groups as well, so that a cluster that all ask for is no single task.
    groups = max(1, -(-asked.count() // block))
    left = asked.mapInPandas(choose, f"id {id_kind}, embedding array<double>, cluster int")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": x["id"].iloc[:0], "key": y["key"].iloc[:0], "distance": np.zeros(0)})
        keys, vs, asks = y["key"].to_numpy(), _matrix(y["embedding"]), _matrix(x["embedding"])
        order = np.argsort(keys, kind="stable")
        keys, vs = keys[order], vs[order]
        i, c = np.nonzero(_candidates(asks, vs, k))
        d = np.round(((vs[c] - asks[i]) ** 2).sum(1), DIGITS)
        order = np.lexsort((c, d, i))
        i, c, d = i[order], c[order], d[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        at = nth < k if cutoff is None else (nth < k) & (d <= cutoff)
        return pd.DataFrame({"id": x["id"].to_numpy()[i[at]], "key": keys[c[at]], "distance": d[at]})

    near = left.groupBy("cluster", "block", "part").cogroup(right.groupBy("cluster", "block", "part")).applyInPandas(best, out)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "key")).cast("long")
    return named(near.withColumn("rank", rank).where(F.col("rank") <= k))
