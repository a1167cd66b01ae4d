"""Scoring and ranking texts against pathways."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import vectors
from strandlake.session import kept

#: Vectors on either side of one block product.
BLOCK = 2048


def _units(rows: pd.Series) -> np.ndarray:
    """Vectors at length 1 as rows of a matrix; a vector without length is all NaN."""
    x = np.stack(rows.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)


def mean_units(chunks: DataFrame, key: str) -> DataFrame:
    """key and the mean of its vectors at length 1 (embedding); vectors without length don't count.

    Tasks sum their vectors per key first, so a key sends one row a batch, not one a vector.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _units(pdf["embedding"])
            fine = ~np.isnan(x[:, 0])
            keys, at = np.unique(pdf[key].to_numpy()[fine], return_inverse=True)
            total = np.zeros((len(keys), x.shape[1]))
            np.add.at(total, at, x[fine])
            yield pd.DataFrame({key: keys, "total": list(total), "n": np.bincount(at, minlength=len(keys))})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[:1], "embedding": [np.sum(np.stack(pdf["total"]), axis=0) / pdf["n"].sum()]})

    part = chunks.where(F.col("embedding").isNotNull()).select(key, "embedding").mapInPandas(sums, f"{key} {kind}, total array<double>, n long")
    return part.groupBy(key).applyInPandas(mean, f"{key} {kind}, embedding array<double>")


def block_products(left: DataFrame, right: DataFrame, a: str, b: str, reduce: str = "all", least: float | None = None, unit: bool = True) -> DataFrame:
    """a, b, score: the product of every vector of left (a, embedding) with every one of right (b, embedding).

    Both sides are dealt to blocks of about BLOCK vectors by the hash of the key, and each pair of blocks is one matrix
    product. Block numbers are ints on either side: equal numbers of different types hash to different partitions. reduce "max" keeps the largest product of each (a, b); least drops smaller
    ones, and vectors without length have no product. Nothing is broadcast: a vector travels once for each block of the
    other side. The number of products is that of all pairs, as an all-pairs score asks for; only results leave a block.
    """
    sides = [df.where(F.col("embedding").isNotNull()).select(F.col(k).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")) for df, k in ((left, a), (right, b))]
    blocks = [-(-max(1, s.count()) // BLOCK) for s in sides]
    dealt = []
    for side, (rows, own, other) in enumerate(zip(sides, blocks, blocks[::-1], strict=True)):
        mine, theirs = F.pmod(F.xxhash64("key"), F.lit(own)).cast("int").alias("ij"[side]), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("ji"[side])
        dealt.append(rows.select("key", "embedding", mine, theirs))
    kinds = [s.schema["key"].dataType.simpleString() for s in sides]

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({a: x["key"].iloc[:0], b: y["key"].iloc[:0], "score": np.zeros(0)})
        matrices = [_units(p["embedding"]) if unit else np.stack(p["embedding"].to_numpy()) for p in (x, y)]
        keys = [x["key"].to_numpy(), y["key"].to_numpy()]
        score = matrices[0] @ matrices[1].T
        if reduce == "max":
            score = np.where(np.isnan(score), -np.inf, score)
            for axis in (0, 1):
                order = np.argsort(keys[axis], kind="stable")
                keys[axis], first = np.unique(keys[axis][order], return_index=True)
                score = np.maximum.reduceat(np.take(score, order, axis), first, axis)
        keep = np.isfinite(score) if least is None else np.nan_to_num(score, nan=-np.inf) >= least
        i, j = np.nonzero(keep)
        return pd.DataFrame({a: keys[0][i], b: keys[1][j], "score": score[i, j]})

    return dealt[0].groupBy("i", "j").cogroup(dealt[1].groupBy("i", "j")).applyInPandas(product, f"{a} {kinds[0]}, {b} {kinds[1]}, score double")


def pair_scores(left: DataFrame, right: DataFrame, keys: tuple[str, str], how: str = "avg", least: float | None = None) -> DataFrame:
    """Mean or maximum cosine, of at least `least`, over all chunk pairs of each (left key, right key).

    A mean needs one product of mean unit vectors per (left key, right key), and no pair of chunks is formed. The means
    are written once, since they are counted before they are multiplied.
    """
    a, b = keys
    if how == "avg":
        return block_products(kept(mean_units(left, a)), kept(mean_units(right, b)), a, b, least=least, unit=False)
    return block_products(left, right, a, b, "max", least)


def scores_of(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """The maximum cosine over the chunk pairs of the given (left key, right key) only; pairs without vectors have no row."""
    a, b = keys
    asked = pairs.select(a, b).distinct()
    met = asked.join(left.select(a, vectors.unit(F.col("embedding")).alias("va")), a).join(right.select(b, vectors.unit(F.col("embedding")).alias("vb")), b)
    return met.groupBy(a, b).agg(F.max(vectors.dot(F.col("va"), F.col("vb"))).alias("score")).where(F.col("score").isNotNull())


def nearest(chunks: DataFrame, query: list[float], k: int = 12, cutoff: float | None = None, key: str = "vec_id") -> DataFrame:
    """The k chunks at least squared distance, at most cutoff away; ties by key."""
    at = F.array(*[F.lit(float(x)) for x in query])
    found = chunks.select(key, vectors.squared_distance(F.col("embedding"), at).alias("distance"))
    found = found.orderBy("distance", key).limit(k)
    return found if cutoff is None else found.where(F.col("distance") <= cutoff)


def nearest_per(chunks: DataFrame, query: list[float], group: str, key: str, k: int = 12, cutoff: float = 50.0, digits: int | None = None) -> DataFrame:
    """chunks with distance (to so many digits) and rank: the k nearest of each group, at most cutoff away; ties by key."""
    at = F.array(*[F.lit(float(x)) for x in query])
    order = Window.partitionBy(group).orderBy("distance", key)
    distance = vectors.squared_distance(F.col("embedding"), at)
    found = chunks.withColumn("distance", distance if digits is None else F.round(distance, digits)).withColumn("rank", F.row_number().over(order).cast("long"))
    return found.where((F.col("rank") <= k) & (F.col("distance") <= cutoff))


def rank_evidence(scored: DataFrame, least_cosine: float = 0.4, least_score: int = 3, n: int = 3, by: tuple[str, ...] = ("pathway",)) -> DataFrame:
    """Per pathway (or other keys) the n best texts: cosine at least the cutoff, reply score missing or at least its cutoff."""
    best = scored.where((F.col("cos_score") >= least_cosine) & (F.col("llm_score").isNull() | (F.col("llm_score") >= least_score)))
    order = Window.partitionBy(*by).orderBy(F.col("cos_score").desc(), F.col("llm_score").desc_nulls_last(), "pmid")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def select_for_interactions(texts: DataFrame, group: str, n: int = 8) -> DataFrame:
    """Up to n texts per group: scored and ranked only where a group has more than n; else all, with a null score."""
    all_rows = Window.partitionBy(group)
    counted = texts.withColumn("_n", F.count("*").over(all_rows)).withColumn("score", F.when(F.col("_n") > n, F.col("score")))
    order = all_rows.orderBy(F.col("score").desc_nulls_last(), "pmid")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).drop("_n")


def with_abstracts(wanted: DataFrame, abstracts: DataFrame) -> DataFrame:
    """wanted (pmid, ...) with the cached abstracts; ids without one go."""
    return wanted.join(abstracts.select("pmid", "abstract"), "pmid")


def mentions(text: str, term: str) -> Column:
    """How often a text has the term, case apart, where no word character stands right before or after it."""
    return F.size(F.split(F.lower(F.col(text)), rf"(?<!\w){re.escape(term.lower())}(?!\w)")) - 1


def search(abstracts: DataFrame, term: str, k: int = 8) -> DataFrame:
    """The k abstracts that mention term most often; ties by id."""
    hits = mentions("abstract", term)
    return abstracts.withColumn("hits", hits.cast("long")).where("hits > 0").orderBy(F.col("hits").desc(), F.col("pmid").cast("long")).limit(k).select("pmid", "hits")


def search_any(abstracts: DataFrame, requests: DataFrame, since: str = "1900-01-01", until: str = "2024-12-31", k: int = 8) -> DataFrame:
    """id, pmid, hits and rank: per request (id, terms) the k abstracts that hold any of its terms most often.

    Terms are single words, case apart; abstracts (pmid, abstract, published) without a date in the range are not
    searched. Words meet in an equi-join, so any number of requests runs as one search; ties go by pmid as a number.
    """
    dated = abstracts.where(F.col("published").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    words = dated.select("pmid", F.explode(F.split(F.lower("abstract"), r"\s+")).alias("term")).where("term <> ''")
    asked = requests.select("id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    counts = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("pmid", "term").agg(F.count("*").alias("n"))
    found = asked.join(counts, "term").groupBy("id", "pmid").agg(F.sum("n").alias("hits"))
    order = Window.partitionBy("id").orderBy(F.col("hits").desc(), F.try_to_number("pmid", F.lit("9" * 18)), "pmid")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
