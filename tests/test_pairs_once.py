"""Pairs of genes are formed, parsed and dealt once, whatever is made of them."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import parsing
from strandlake.operators import network
from strandlake.plans import fixtures

LINE = "l_orderkey long, l_partkey long, l_returnflag string"
ROWS = [(1, 5, "N"), (1, 5, "N"), (1, 5, "A"), (1, 6, "A"), (1, 7, "R"), (1, 9, "N"), (2, 6, "R"), (2, 5, "R"), (2, 5, None), (3, None, "N"), (3, 1, "N"), (None, 1, "N"), (None, 2, "N"), (4, 6, "N"), (4, 5, "N"), (5, 8, "N")]


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture()
def inputs(spark, tmp_path):
    spark.createDataFrame(ROWS, LINE).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return fixtures.Inputs(spark, str(tmp_path))


@pytest.mark.parametrize("view", ["ppi_intact", "ppi_biogrid"])
def test_interactions_are_those_of_the_view(spark, inputs, view):
    pair = spark.sql(fixtures.VIEWS["pair"], lineitem=inputs.lineitem)
    said = spark.sql(fixtures.VIEWS[view], pair=pair)
    got = getattr(inputs, view)
    assert said.columns == got.columns and sorted(map(tuple, said.collect())) == sorted(map(tuple, got.collect()))
    assert said.count() > 0 and "Join" not in _plan(got)


def test_edges_and_totals_read_their_source_once(inputs):
    found = network.intact_interactions(inputs.intact_raw)
    for df in (network.edges(found), network.totals(found)):
        assert _plan(df).count("FileScan") == 1 and _plan(df).count("regexp_extract") <= 6  # three columns, named twice at most


def test_pairs_come_from_either_end_once(spark):
    rows = spark.createDataFrame([("A", "B", "2"), ("B", "A", "1"), ("B", "A", "1"), ("C", "C", "3"), (None, "A", "4"), ("A", None, None), (None, None, "5")], "gene_a string, gene_b string, pmid string")
    flat = network.both_ways(rows)
    key = lambda r: str(r)
    said = flat.groupBy("gene", "partner").agg(F.array_sort(F.collect_set("pmid")).alias("pmids")).collect()
    assert sorted(said, key=key) == sorted(network.edges(rows).collect(), key=key)
    some = network.edges(rows, only=F.col("gene") == "A").collect()
    assert sorted(some, key=key) == sorted((r for r in said if r.gene == "A"), key=key)
    assert tuple(network.totals(rows).first()) == (flat.select("gene", "partner").distinct().count() / 2, 5)
    assert tuple(network.totals(rows.limit(0)).first()) == (0.0, 0)


def test_a_symbol_ends_at_its_colon_or_mark(spark):
    said = {"uniprotkb:A:B(gene name)|x": "A", "uniprotkb:A(gene name):B(gene name)": "A", "uniprotkb:A(gene name)(gene name)": "A(gene name)", "uniprotkb:P1|uniprotkb:Q(gene name)": "Q", "xuniprotkb:A(gene name)": None, "uniprotkb:A(gene name)\n": None, "y|uniprotkb:(gene name)": None}
    rows = spark.createDataFrame(list(said.items()), "alias string, symbol string").select("symbol", parsing.tagged_gene("alias").alias("got"))
    assert all(r.symbol == r.got for r in rows.collect())
