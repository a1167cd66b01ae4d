import math

import pytest
from pyspark.sql import functions as F

from strandlake.functions import parsing, stats
from strandlake.operators import enrichment, network


def test_parsers_take_the_first_matching_token(spark):
    rows = spark.createDataFrame(
        [("psi-mi:x(display_long)|uniprotkb:ABC1(gene name)|uniprotkb:Z(gene name)", "imex:I|pubmed:1|pubmed:2"), ("uniprotkb:X(gene name synonym)", "imex:I"), (None, None), ("", "")], "alias string, pubs string"
    )
    got = rows.select(parsing.tagged_gene("alias"), parsing.tagged_publication("pubs")).collect()
    assert [tuple(r) for r in got] == [("ABC1", "1"), (None, None), (None, None), (None, None)]


def test_prefixed_publication_is_case_sensitive(spark):
    rows = spark.createDataFrame([("PUBMED:7",), ("pubmed:7",), (None,)], "s string")
    assert [r[0] for r in rows.select(parsing.prefixed_publication("s")).collect()] == ["7", None, None]


def test_edges_are_symmetric_and_merge_publications(spark):
    a = spark.createDataFrame([("A", "B", "1"), ("B", "A", "2"), ("A", "C", "1")], "gene_a string, gene_b string, pmid string")
    b = spark.createDataFrame([("A", "B", "3")], "gene_a string, gene_b string, pmid string")
    got = {(r.gene, r.partner): r.pmids for r in network.edges(a, b).collect()}
    assert got[("A", "B")] == got[("B", "A")] == ["1", "2", "3"] and got[("C", "A")] == ["1"]
    assert tuple(network.totals(a, b).first()) == (2.0, 3)


def test_self_and_incomplete_interactions_go(spark):
    raw = spark.createDataFrame([("A", "A", "PUBMED:1"), ("A", "", "PUBMED:1"), ("A", "B", "DOI:1"), ("A", "B", "PUBMED:1"), (None, "B", "PUBMED:1")], "symbol_a string, symbol_b string, source string")
    assert [tuple(r) for r in network.biogrid_interactions(raw).collect()] == [("A", "B", "1")]


def test_score_cutoff_is_strict_and_source_is_checked(spark):
    edges = network.edges(spark.createDataFrame([("A", "B", "1"), ("A", "C", "1")], "gene_a string, gene_b string, pmid string"))
    fi = spark.createDataFrame([("B", "A", 0.81), ("A", "C", 0.8)], "gene_a string, gene_b string, score double")
    kept = network.choose_source("intact_biogrid", edges, fi).select("gene", "partner").collect()
    assert sorted(map(tuple, kept)) == [("A", "B"), ("B", "A")]
    assert network.choose_source("intact_biogrid", edges, fi, use_filter=False).count() == 4
    with pytest.raises(ValueError, match="unknown"):
        network.choose_source("other", edges, fi)


def test_binomial_tail_anchor_and_edges(spark):
    rows = spark.createDataFrame([(3, 10, 1, 10), (0, 10, 1, 10), (10, 10, 10, 10), (2, 2, 1, 2)], "k long, n long, size long, background long")
    got = {r.k: r.p_value for r in stats.with_tails(rows, "k", "n", "size", "background").collect()}
    assert got[3] == pytest.approx(0.0701908264, abs=1e-10)
    assert got[0] == 1.0 and got[10] == 1.0 and got[2] == pytest.approx(0.25)


def test_benjamini_hochberg_is_monotone_and_ties_share(spark):
    ps = [0.01, 0.02, 0.02, 0.5, 0.9]
    rows = spark.createDataFrame([("g", p) for p in ps], "g string, p double")
    got = [tuple(r) for r in stats.benjamini_hochberg(rows, "p", ["g"]).orderBy("p").select("p", "fdr").collect()]
    assert [q for _, q in got] == sorted(q for _, q in got) and all(q >= p for p, q in got)
    assert got[1] == got[2] and got[0][1] == pytest.approx(0.02 * 5 / 3)


def _brute(partners, membership):
    """p values of one gene by math.comb."""
    sets, listed = {}, {}
    for pathway, gene in membership:
        sets.setdefault(pathway, set()).add(gene)
        listed[pathway] = listed.get(pathway, 0) + 1
    background = {g for _, g in membership}
    test = [g for g in partners if g in background]
    out = {}
    for pathway, genes in sets.items():
        k = sum(g in genes for g in test)
        if k:
            p = listed[pathway] / len(background)
            out[pathway] = sum(math.comb(len(test), i) * p**i * (1 - p) ** (len(test) - i) for i in range(k, len(test) + 1)) if p < 1 else 1.0
    ranked = sorted(out.values())
    fdr, best = {}, 1.0
    for r in range(len(ranked), 0, -1):
        best = min(best, ranked[r - 1] * len(ranked) / r)
        fdr[ranked[r - 1]] = best
    return {k: (p, fdr[p]) for k, p in out.items()}


def test_enrichment_of_many_genes_against_brute_force(spark):
    membership = [(p, g) for p in range(12) for g in range(40) if (g * 7 + p * 5) % (3 + p % 4) == 0] + [(0, 0)]
    partners = {q: [g for g in range(0, 50) if (g * q) % 5 < 2] for q in range(1, 6)}
    m = spark.createDataFrame(membership, "pathway_id long, gene long")
    p = spark.createDataFrame([(q, g) for q, gs in partners.items() for g in gs], "query_gene long, partner long")
    got = {(r.query_gene, r.pathway_id): (r.p_value, r.fdr) for r in enrichment.partner_enrichment(p, m, None).collect()}
    want = {(q, k): v for q, gs in partners.items() for k, v in _brute(gs, membership).items()}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert got[k][0] == pytest.approx(a, abs=1e-12) and got[k][1] == pytest.approx(b, abs=1e-12)
    top = enrichment.top(enrichment.partner_enrichment(p, m, None), 2).groupBy("query_gene").count().collect()
    assert all(r["count"] <= 2 for r in top)


def test_enrichment_without_hits_is_empty(spark):
    m = spark.createDataFrame([(1, 1)], "pathway_id long, gene long")
    p = spark.createDataFrame([(9, 5)], "query_gene long, partner long")
    assert enrichment.partner_enrichment(p, m, None).count() == 0


def test_list_form_counts_unmapped_genes(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "pathway_id long, gene long")
    lists = spark.createDataFrame([(7, 1), (7, 99), (7, 1)], "query_gene long, gene long")
    got = enrichment.list_enrichment(lists, m).first()
    assert got.n_test == 2 and got.p_value == pytest.approx(1 - 0.5**2)


def test_without_annotated(spark):
    e = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.2)], "query_gene long, pathway_id long, fdr double")
    a = spark.createDataFrame([(1, 10)], "query_gene long, pathway_id long")
    assert [r.pathway_id for r in enrichment.without_annotated(e, a).collect()] == [11]


def test_reply_score_and_names(spark):
    rows = spark.createDataFrame([("**score: 7** score: 3",), ("Score: 7",), (None,)], "t string")
    assert [r[0] for r in rows.select(parsing.reply_score("t")).collect()] == [7, None, None]
    named = spark.createDataFrame([("a: b\n\nc",)], "t string")
    assert named.select(parsing.leading_names("t")).first()[0] == ["a", "", "c"]
    assert named.select(parsing.flat_publications(F.array(F.lit("1|2"), F.lit("")))).first()[0] == ["1", "2", ""]


def _enrichment_case(spark):
    membership = [(p, g) for p in range(60) for g in range(90) if (g * 7 + p * 5) % (3 + p % 9) == 0] + [(0, 0)]
    partners = {q: [g for g in range(0, 100) if (g * q) % 7 < 2] for q in range(1, 30)}
    m = spark.createDataFrame(membership, "pathway_id long, gene long")
    return membership, partners, m, spark.createDataFrame([(q, g) for q, gs in partners.items() for g in gs], "query_gene long, partner long")


@pytest.mark.parametrize("at_once", [1 << 20, 40])
def test_enrichment_in_pieces_with_text_ids(spark, monkeypatch, at_once):
    """Genes that span tables, and genes of more rows than fit one, are tested as whole ones."""
    from pyspark import cloudpickle

    membership, partners, m, p = _enrichment_case(spark)
    monkeypatch.setattr(enrichment, "_AT_ONCE", at_once)
    cloudpickle.register_pickle_by_value(enrichment)
    try:
        with_text = m.withColumn("pathway_id", F.concat(F.lit("P"), "pathway_id"))
        for sets, key in ((m, lambda x: x), (with_text, lambda x: int(x[1:]))):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
            got = {(r.query_gene, key(r.pathway_id)): (r.p_value, r.fdr) for r in enrichment.partner_enrichment(p, sets, None).collect()}
            want = {(q, k): v for q, gs in partners.items() for k, v in _brute(gs, membership).items()}
            assert got.keys() == want.keys()
            for k, v in want.items():
                assert got[k] == pytest.approx(v, abs=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        cloudpickle.unregister_pickle_by_value(enrichment)


def test_best_and_annotated_are_chosen_where_the_gene_is(spark):
    """The same rows as top() and without_annotated() give on everything, and no pair of gene and pathway is shuffled for them."""
    _, _, m, p = _enrichment_case(spark)
    a = m.select((F.col("gene") % 30).alias("query_gene"), "pathway_id").distinct()
    rounded = lambda df: df.withColumn("fdr", F.round("fdr", 10))
    everything = enrichment.partner_enrichment(p, m, None)
    rows = lambda df: sorted(tuple(r) for r in enrichment.top(rounded(df), 4).select(*everything.columns, "rank").collect())
    assert rows(everything) == rows(enrichment.partner_enrichment(p, m, None, 4))
    assert rows(enrichment.without_annotated(everything, a)) == rows(enrichment.partner_enrichment(p, m, None, 4, a))
    assert enrichment.partner_enrichment(p, m, None, 4).count() < everything.count() / 2


def test_arrays_of_tails_equal_the_expression(spark):
    import numpy as np

    cases = [(k, n, s) for n in (1, 5, 80, 3000) for k in (0, 1, 2, 15, 16, 17, 40, 200) for s in (1, 7, 400, 1000)]
    df = spark.createDataFrame(cases, "k long, n long, size long").withColumn("background", F.lit(1000).cast("long"))
    want = {(r.k, r.n, r["size"]): r.p_value for r in stats.with_tails(df, "k", "n", "size", "background").collect()}
    k, n, s = (np.array(x) for x in zip(*cases, strict=True))
    for case, got in zip(cases, stats.binomial_tails(k, n, np.minimum(s / 1000, 1.0)), strict=True):
        assert got == pytest.approx(want[case], rel=1e-9, abs=1e-300), case
