"""Every corpus query with an oracle gives the oracle's rows on the smallest tables; the others give one row a document."""

import os

import duckdb
import pytest

from strandlake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[rel.columns.index(c)] for c in cols]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_piece_codec", "op3_line_dedup", "op7_substring_dedup", "op9_toxicity", "op10_token_counts", "op11_bpe_codec", "op13_manifest"])
def test_one_row_a_document(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = registry.QUERIES[name](spark, SF)
    assert rows.select("doc_id").distinct().count() == rows.count() == documents
    if name == "op2_piece_codec":
        assert rows.where("not round_trip").count() == 0
