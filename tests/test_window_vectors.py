"""Windows, their vectors and their neighbours cost what reading them costs."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strandlake.functions import vectors
from strandlake.operators import models, neighbours
from strandlake.plans import catalog


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_not_copied_to_every_window(spark):
    texts = [None, "", " \t\n", " a  b\x0bc\fd ", " ".join(map(str, range(27))), "x y z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    cut = vectors.token_windows(rows, "t", 12, 2)
    assert "explode(sequence" not in _plan(cut) and cut.columns == ["id", "t", "start", "chunk"]
    got = sorted((r.id, r.start, r.chunk) for r in cut.collect() if r.id)
    want = []
    for n, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        want += [(n, a, " ".join(w[a : a + 12])) for a in range(0, max(len(w) - 2, 1), 10) if n]
    assert got == want and [(r.start, r.chunk) for r in cut.where("id = 0").collect()] == [(0, None)]


def test_a_vector_counts_its_words_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"Word{x}" for x in rng.integers(0, 900, n)) for n in (1, 2, 255, 256, 3000)] + ["a b c", "İx É", None]
    rows = models.embed(spark.createDataFrame(list(enumerate(texts)), "n long, t string"), "t")
    assert "lambda" not in _plan(rows)  # a pass over the words for every place
    for r in rows.collect():
        words = r.t and [w.decode() for w in r.t.encode().split()]
        if words and "İ" not in r.t and " " not in r.t:
            assert r.embedding == models.hashed_vector(r.t).tolist()
        assert len(r.embedding) == 64 and any(r.embedding) == bool(words)
    monkeypatch.setattr(models, "_WORDS", 5)  # words that are forgotten are hashed again
    again = models.embed(spark.createDataFrame(list(enumerate(texts)), "n long, t string"), "t")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_few_candidates_and_none_lost():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(20, 64)), rng.normal(size=(900, 64))
    y[300:310] = y[0]  # ties
    may = neighbours._candidates(x, y, 12)
    d = np.round(((x[:, None] - y[None]) ** 2).sum(2), neighbours.DIGITS)
    assert all(may[i][d[i] <= np.sort(d[i])[11]].all() for i in range(20)) and may.sum(1).max() < 40
    y[5, 3] = np.inf
    assert neighbours._candidates(x, y, 12).all() and neighbours._candidates(x, y[:12], 12).all()


def test_texts_without_words_are_no_neighbours(spark, tmp_path):
    docs = [(1, ""), (2, None), (3, "alpha beta"), (4, " \n"), (5, "gamma")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha delta")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES["nearest_chunks_of_requests"](spark, str(tmp_path)).select("id", "part", "distance", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(catalog.ORACLES["nearest_chunks_of_requests"]).fetchall())
    assert got.where(F.col("part").startswith("3:")).first()["rank"] == 1
