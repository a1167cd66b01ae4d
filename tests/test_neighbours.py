"""Nearest neighbours of many queries against all distances, and the stand-in vectors in both forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import models, neighbours

VECTOR, QUERY = "vec_id long, embedding array<float>", "id string, embedding array<float>"


def brute(vectors, queries, k, cutoff=None):
    out = set()
    for i, q in queries:
        if q is None:
            continue
        d = [(round(float(((np.float32(v).astype(float) - np.float32(q).astype(float)) ** 2).sum()), neighbours.DIGITS), key) for key, v in vectors if v is not None]
        out |= {(i, key, x, r) for r, (x, key) in enumerate(sorted(d)[:k], 1) if cutoff is None or x <= cutoff}
    return out


@pytest.mark.parametrize("k, cutoff, centroids, block", [(5, None, 6, 40), (300, None, 3, 7), (4, 0.8, 64, 2048)])
def test_all_neighbours_are_found(spark, k, cutoff, centroids, block):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(5, 6)) * 3
    rows = [(n, (centers[min(n % 9, 4)] + rng.normal(size=6) * 0.3).tolist()) for n in range(240)]  # one cluster has half
    rows += [(1000 + n, rows[n % 3][1]) for n in range(9)] + [(2000, None)]  # equal vectors
    asked = [(f"q{n}", (centers[n % 5] + rng.normal(size=6)).tolist()) for n in range(12)] + [("same", rows[0][1]), ("far", [50.0] * 6), ("none", None)]
    got = neighbours.nearest_many(spark.createDataFrame(rows, VECTOR).repartition(3), spark.createDataFrame(asked, QUERY), k, cutoff, centroids=centroids, block=block)
    assert {(r.id, r.vec_id, round(r.distance, neighbours.DIGITS), r["rank"]) for r in got.collect()} == brute(rows, asked, k, cutoff)


def test_neighbours_in_one_of_several_far_clusters(spark):
    rows = [(n, [float(n // 50) * 100, float(n % 50)]) for n in range(200)]
    asked = spark.createDataFrame([("a", [0.0, 3.2])], QUERY)
    got = neighbours.nearest_many(spark.createDataFrame(rows, VECTOR), asked, 3, centroids=40)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [3, 4, 2]


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], VECTOR), spark.createDataFrame([(1, [1.0])], VECTOR)
    asked = spark.createDataFrame([("a", [1.0])], QUERY)
    assert neighbours.nearest_many(none, asked).collect() == [] == neighbours.nearest_many(some, asked.where("id = 'b'")).collect()


def test_vectors_are_the_same_in_both_forms(spark):
    texts = ["one two three two", "", None, "  Ü é\tß  one ", "x" * 50]
    rows = models.embed(spark.createDataFrame(list(enumerate(texts)), "n long, t string"), "t").orderBy("n").collect()
    for r in rows:
        assert r.embedding == models.hashed_vector(r.t or "").tolist()
    assert sum(x * x for x in rows[0].embedding) == pytest.approx(1) and not any(rows[1].embedding)
    assert models.embed(spark.createDataFrame([("a b",)], "t string"), "t", "v", 8).select(F.size("v")).first()[0] == 8
