"""Products of vectors over several blocks on either side, where no two partitions are merged."""

import numpy as np
import pytest

from strandlake.operators import evidence


@pytest.mark.parametrize("reduce", ["all", "max"])
def test_no_pair_of_blocks_is_lost(spark, monkeypatch, reduce):
    monkeypatch.setattr(evidence, "BLOCK", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(5)
        x, y = rng.normal(size=(30, 4)), rng.normal(size=(50, 4))
        left = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "a long, embedding array<double>")
        right = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "b long, embedding array<double>")
        got = {(r.a, r.b): r.score for r in evidence.block_products(left, right, "a", "b", reduce).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert len(got) == 1500 and all(abs(want[k] - v) < 1e-12 for k, v in got.items())
