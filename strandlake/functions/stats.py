"""Binomial tails and false-discovery rates as native expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FEW, LEAST = 16, 1e-5


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, less the logs of the eight factors too many: exact to about 1e-14 relative."""
    x = n.cast("double") + 9.0
    r = 1.0 / x
    series = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r * (1 / 1680 - r * r / 1188))))
    factors = x - 1.0
    for k in range(2, 9):
        factors = factors * (x - float(k))
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + series - F.log(factors)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, p): a first term in log space, each next one by its ratio to the one before.

    For k up to FEW the k terms below it are summed first; what they leave of 1 counts unless it is less than LEAST, where
    the difference would lose its digits. Else the sum of the tail itself begins at k, or 20 terms and 12 standard deviations before the mean if that is later, and ends as far past k
    or the mean, whichever is larger: what it leaves out is less than one part in 10**16 of the total.
    """
    far = F.lit(20) + F.ceil(12.0 * F.sqrt(n * p * (1.0 - p)))
    start = F.greatest(k, F.floor(n * p) - far)
    first = F.exp(log_factorial(n) - log_factorial(start) - log_factorial(n - start) + start * F.log(p) + (n - start) * F.log1p(-p))
    odds = p / (1.0 - p)
    none = F.array().cast("array<bigint>")

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1).cast("double") / i.cast("double") * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    def added(begin: Column, rest: Column) -> Column:
        return F.aggregate(rest, F.struct(begin.alias("term"), begin.alias("total")), step, lambda acc: acc["total"])

    past = F.least(n, F.greatest(k, F.ceil(n * p)) + far)
    tail = F.least(F.lit(1.0), added(first, F.when(past > start, F.sequence(start + 1, past)).otherwise(none)))
    left = 1.0 - added(F.exp(n * F.log1p(-p)), F.when(k > 1, F.sequence(F.lit(1).cast("long"), k - 1)).otherwise(none))
    short = F.element_at(F.transform(F.array(left), lambda x: F.when(x >= LEAST, x).otherwise(tail)), 1)
    return F.when((k <= 0) | (p >= 1.0), F.lit(1.0)).when(k > n, F.lit(0.0)).when(k <= FEW, short).otherwise(tail)


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """log_factorial of an array."""
    x = n + 9.0
    r = 1.0 / x
    series = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r * (1 / 1680 - r * r / 1188))))
    factors = np.prod([x - float(k) for k in range(1, 9)], axis=0)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + series - np.log(factors)


def binomial_tails(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """binomial_tail of arrays, by the same terms."""
    sure, k, n = p >= 1.0, k.astype(np.float64), n.astype(np.float64)
    p = np.where(sure, 0.5, p)
    odds, low = p / (1.0 - p), np.clip(k, 0, n)
    far = 20 + np.ceil(12.0 * np.sqrt(n * p * (1.0 - p)))
    start = np.maximum(low, np.floor(n * p) - far)
    past = np.minimum(n, np.maximum(low, np.ceil(n * p)) + far)

    def added(term: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        total, term, open_ = term.copy(), term.copy(), np.flatnonzero(first < last)
        i = first.copy()
        while len(open_):
            i[open_] += 1
            term[open_] *= (n[open_] - i[open_] + 1) / i[open_] * odds[open_]
            total[open_] += term[open_]
            open_ = open_[i[open_] < last[open_]]
        return total

    first = np.exp(_log_factorials(n) - _log_factorials(start) - _log_factorials(n - start) + start * np.log(p) + (n - start) * np.log1p(-p))
    tail = np.minimum(1.0, added(first, start, past))
    left = 1.0 - added(np.exp(n * np.log1p(-p)), np.zeros_like(k), np.where(k <= FEW, low - 1, 0.0))
    out = np.where((k <= FEW) & (left >= LEAST), left, tail)
    return np.where((k <= 0) | sure, 1.0, np.where(k > n, 0.0, out))


def with_tails(df: DataFrame, k: str, n: str, size: str, background: str, out: str = "p_value") -> DataFrame:
    """df with the binomial tail of each row."""
    p = F.least(F.col(size).cast("double") / F.col(background), F.lit(1.0))
    return df.withColumn(out, binomial_tail(F.col(k).cast("long"), F.col(n).cast("long"), p))


def benjamini_hochberg(df: DataFrame, p: str, group: list[str], out: str = "fdr") -> DataFrame:
    """df with q values: the least p * m / rank of this and all larger p within the group, at most 1."""
    everyone = Window.partitionBy(*group)
    ranked = df.withColumn("_rank", F.row_number().over(everyone.orderBy(p))).withColumn("_m", F.count("*").over(everyone))
    upward = everyone.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(upward))
    return ranked.withColumn(out, q).drop("_rank", "_m")
