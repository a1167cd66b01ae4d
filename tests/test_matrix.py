"""A matrix on disk: the rows in order, their owners, and blocks that can be mapped."""

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import graph
from strandlake.sources import matrix

CHUNK = "db_id long, display_name string, start_index long, embedding array<float>"


def test_round_trip_in_order(spark, tmp_path):
    rng, path = np.random.default_rng(1), f"file://{tmp_path}/m"
    rows = [(n // 5, f"n{n // 5}", None if n % 5 == 0 else n % 5 * 100, rng.normal(size=3).astype(np.float32).tolist()) for n in range(103)] + [(999, "none", 5, None), (999, "part", 7, [1.0, None, 2.0])]
    matrix.save_matrix(spark.createDataFrame(rows, CHUNK).repartition(4), path, 16)
    got = matrix.matrix_rows(spark, path).orderBy("row").collect()
    want = sorted(rows, key=lambda r: (r[0], -1 if r[2] is None else r[2]))
    assert [(r.row, r.db_id, r.display_name, r.start_index) for r in got] == [(k, r[0], r[1], "-1" if r[2] is None else str(r[2])) for k, r in enumerate(want)]
    assert all(r.vector == w[3] for r, w in zip(got[:103], want, strict=False))
    assert np.isnan(got[103].vector).all() and np.isnan(got[104].vector).tolist() == [False, True, False]
    blocks = matrix.matrix_blocks(spark, path, 20, 40).orderBy("first").collect()
    assert [(b.block, b.first, b.n, b.dims) for b in blocks] == [(1, 16, 16, 3), (2, 32, 16, 3)]
    assert np.frombuffer(blocks[0].data, "<f4").reshape(16, 3)[4].tolist() == want[20][3]


def test_empty_matrix(spark, tmp_path):
    matrix.save_matrix(spark.createDataFrame([], CHUNK), f"file://{tmp_path}/m")
    assert matrix.matrix_rows(spark, f"file://{tmp_path}/m").count() == 0


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(5)
    assert {(r.k, r.ord) for r in graph.numbered(rows, "k").collect()} == {(k, k) for k in range(1000)}
