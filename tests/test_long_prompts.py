"""A prompt over all abstracts of a source is digested as it passes, never gathered."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.functions import texts
from strandlake.plans import catalog

DOCS = [(3, "a", "three"), (1, "a", "oéne"), (2, "a", None), (4, None, "four"), (6, None, "{text}"), (5, "b", None), (7, "{gene}", ""), (10, "c", "ten" * 9000), (9, "c", "\U0001f9ec"), (None, "c", "lost")]


@pytest.mark.parametrize("name", ["prompt_render", "context_text"])
def test_digests_of_odd_sources(spark, tmp_path, name):
    spark.createDataFrame(DOCS, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found, rel = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLES[name])
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    cols = sorted(found.columns)
    assert sorted(str([r[c] for c in cols]) for r in found.collect()) == sorted(str([r[rel.columns.index(c)] for c in cols]) for r in rel.fetchall())


def test_the_digest_is_that_of_the_context(spark):
    rows = spark.createDataFrame([(str(n % 3), n, str(n), f"text {n} " * (n % 5)) for n in range(200)], "g string, o long, pmid string, abstract string").repartition(7)
    whole = {r.g: r.context for r in texts.abstracts_context(rows, "g", "o").collect()}
    for r in texts.abstracts_digest(rows, "g", F.concat(F.lit("<"), "g"), F.lit(">"), "o").collect():
        said = "<" + r.g + whole[r.g] + ">"
        assert (r.n_chars, r.digest) == (len(said), hashlib.md5(said.encode()).hexdigest()) and r.n_abstracts in (66, 67)
