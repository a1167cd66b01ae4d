"""Composed stages, block products, schema checks and sources against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import decisions, parsing, schemas, stats, texts
from strandlake.operators import annotate, evidence, graph, jobs, network, tools
from strandlake.sources import files


def vector_rows(rng, n, keys, dim=8):
    return [(rng.randrange(keys), [rng.gauss(0, 1) for _ in range(dim)] if rng.random() > 0.05 else [0.0] * dim) for _ in range(n)]


@pytest.mark.parametrize("block", [2048, 7])
def test_block_products_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(evidence, "BLOCK", block)
    rng = random.Random(3)
    left, right = vector_rows(rng, 40, 9), vector_rows(rng, 60, 11)
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    pairs = [(a, b, cos(x, y)) for a, x in left for b, y in right if any(x) and any(y)]
    l, r = spark.createDataFrame(left, "p long, embedding array<double>"), spark.createDataFrame([(str(k), v) for k, v in right], "d string, embedding array<double>")
    for how, fold in (("avg", np.mean), ("max", max)):
        want = {(a, str(b)): fold([s for x, y, s in pairs if (x, y) == (a, b)]) for a, b, _ in pairs}
        got = {(x.p, x.d): x.score for x in evidence.pair_scores(l, r, ("p", "d"), how).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    every = evidence.block_products(l, r, "p", "d", least=0.3).collect()
    assert sorted((x.p, int(x.d), round(x.score, 9)) for x in every) == sorted((a, b, round(s, 9)) for a, b, s in pairs if s >= 0.3)
    assert evidence.pair_scores(l.limit(0), r, ("p", "d"), "max").count() == 0


def test_tails_against_exact_sums(spark):
    cases = [(k, n, s, b) for n in (1, 5, 60, 400) for s, b in ((1, 1000), (30, 400), (399, 400), (5, 7)) for k in {1, 2, n // 2, n - 1, n} if 0 < k <= n]
    got = stats.with_tails(spark.createDataFrame(cases, "k long, n long, s long, b long"), "k", "n", "s", "b").collect()
    for r in got:
        p = r.s / r.b
        want = math.fsum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k, r.n + 1))
        assert r.p_value == pytest.approx(want, rel=1e-9)


def test_an_edge_that_stands_twice_has_one_score(spark):
    scored = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.9), ("a", "c", 0.2), ("a", "x", 0.9)], "gene_a string, gene_b string, score double")
    index = spark.createDataFrame([("b", 1), ("c", 2)], "gene string, idx int")
    docs = network.network_documents(scored, index)
    assert [(r.gene, r.combined_score) for r in docs.collect()] == [("a", {1: 0.9, 2: 0.2})]
    assert [tuple(r) for r in network.network_partners(docs, index).collect()] == [("a", "b", 0.9)]


def test_terms_are_taken_as_they_are(spark):
    rows = spark.createDataFrame([("1", "c++ and C++ and c"), ("2", "plain c"), ("3", "a.b"), ("4", "axb")], "pmid string, abstract string")
    assert [tuple(r) for r in evidence.search(rows, "c++").collect()] == [("1", 2)]
    assert [r.pmid for r in evidence.search(rows, "a.b").collect()] == ["3"]


def test_search_takes_any_term_inside_the_dates(spark):
    rows = spark.createDataFrame([("1", "X y x", "2000-01-01"), ("2", "x", "2024-12-31"), ("3", "x x", "2025-01-01"), ("4", "z", None), ("10", "z", "1900-01-01")], "pmid string, abstract string, d string").withColumn("published", F.to_date("d"))
    asked = spark.createDataFrame([("q", ["x", "Z", "x"]), ("none", ["nowhere"])], "id string, terms array<string>")
    assert [(r.id, r.pmid, r.hits, r["rank"]) for r in evidence.search_any(rows, asked).orderBy("rank").collect()] == [("q", "1", 2, 1), ("q", "2", 1, 2), ("q", "10", 1, 3)]
    assert evidence.search_any(rows, asked, k=1).count() == 1
    said, papers = tools.literature(spark.createDataFrame([(1, "x", "z"), (2, " ", "z"), (3, "none", None)], "id long, gene string, more string"), rows.withColumn("journal", F.lit(None).cast("string")), "1900-01-01", "2024-12-31")
    assert {r.id: r.papers_found for r in said.collect()} == {1: 3, 2: 0, 3: 0}
    first = papers.where("rank = 1").first().paper
    assert (first.pmid, first.title, first.journal, first.year) == ("1", "", "", "2000")


def test_every_empty_stage_has_its_status(spark):
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_gene long")
    got = annotate.statuses(of(1, 2, 3, 4, 5, 5), [of(2, 3, 4, 5), of(1, 3, 4, 5, 5), of(4, 5), of(5, 5)])
    assert {r.query_gene: r.status for r in got.collect()} == {1: "no_abstract", 2: "no_interaction", 3: "no_pathway", 4: "no_support", 5: "ok"}


def test_only_pathways_with_text_count(spark):
    roles = spark.createDataFrame([("p2", "r", "reactant", "G"), ("p3", "r", "catalyst", "G"), ("p3", "q", "reactant", "H")], "pathway string, reaction string, role string, gene string")
    pathways = spark.createDataFrame([("p1", "one", "s"), ("p2", "two", None), ("p3", "three", "sum")], "pathway string, name string, summary string")
    asked = spark.createDataFrame([(1, p, g) for p in ("p1", "p2", "p3") for g in ("G", "H", "G")], "query_gene long, pathway string, gene string")
    made = {r.pathway: r for r in annotate.pathway_texts(asked, roles, pathways).collect()}
    assert made.keys() == {"p2", "p3"} and (made["p3"].genes, made["p3"].role_text) == ("G,H", 'G in "r" as catalyst; H in "q" as reactant')
    enriched = spark.createDataFrame([(1, "p1", 0.01), (1, "p2", 0.02), (1, "p3", 0.03)], "query_gene long, pathway_id string, fdr double")
    chosen = annotate.first_with_text(enriched, annotate.pathway_texts(asked, roles, pathways), 1)
    assert [(r.pathway, r["rank"]) for r in chosen.collect()] == [("p2", 1)]
    partners = spark.createDataFrame([(1, "G"), (1, "H"), (2, "G")], "query_gene long, partner string")
    whole, each = annotate.interacting_summaries(chosen, partners)
    assert [(r.query_gene, r.fdrs) for r in whole.collect()] == [(1, "two:2.000e-02\n")] and each.count() == 1
    named = enriched.withColumn("name", F.when(F.col("pathway_id") == "p2", "two").otherwise("other"))
    assert [r.pathway_id for r in annotate.used(named, chosen).collect()] == ["p2"]


def test_one_pathway_is_summarised_once_and_several_twice(spark):
    annotated = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c")], "query_gene long, pathway string")
    described = spark.createDataFrame([(1, "a", "A", "x"), (2, "a", "A", "x"), (2, "b", "B", "y")], "query_gene long, pathway string, name string, text string")
    got = {r.query_gene: r for r in annotate.annotated_summaries(annotated, described).collect()}
    assert got.keys() == {1, 2} and got[1].docs == "x" and [line.split(":")[0] for line in got[2].docs.split("\n\n")] == ["A", "B"]


def test_schema_violations():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 2, "items": {"type": ["integer", "null"], "minimum": 0}}, "b": {"enum": ["x", 1]}, "c": {"type": "string", "minLength": 2}}, "additionalProperties": False, "format": "f"}
    assert schemas.violations({"a": [1, None]}, schema) == []
    assert schemas.violations([], schema) == ["$: not of type object"]
    assert schemas.violations({"a": [True, -1], "b": "y", "c": "z", "d": 0}, schema) == ["$: d is not allowed", "$.a[0]: not of type integer or null", "$.a[1]: out of range", "$.b: not one of the listed values", "$.c: too short"]
    assert schemas.violations({"a": [1.0]}, schema) == ["$.a: too few items"] and schemas.violations({}, schema) == ["$: a is required"]
    assert schemas.unknown(schema) == ["schema keyword format is not checked"]


def test_reports_on_unreadable_and_empty_batches(spark):
    rows = spark.createDataFrame([(1, '{"entities":[{}]}'), (2, "no"), (3, "[]"), (4, None), (5, "{}")], "batch_id long, doc string")
    got = {r.batch_id: (r.valid, r.errors) for r in decisions.validation_report(rows).collect()}
    assert got == {1: (False, ["missing class in entity", "missing displayName in entity"]), 2: (False, ["no JSON object"]), 3: (False, ["no JSON object"]), 4: (False, ["no JSON object"]), 5: (True, [])}
    checked = decisions.validation_report(rows, {"required": ["x"], "oneOf": []}).where("batch_id = 5").first()
    assert checked.errors == ["$: x is required"] and checked.warnings == ["schema keyword oneOf is not checked"]


def test_records_keep_what_was_said(spark):
    rows = spark.createDataFrame([('{"a":1}',), ('[{"b":"x"},2]',), ("word",), ("7",), (None,)], "t string")
    got = [[json.loads(x) for x in r[0]] for r in rows.select(parsing.records_of("t")).collect()]
    assert got == [[{"a": 1}], [{"b": "x"}, 2], [{"content": "word", "type": "raw_text"}], [{"content": "7", "type": "unknown"}], [{"content": "", "type": "raw_text"}]]
    said = [r.c for r in rows.select(parsing.consensus_of("t").alias("c")).collect()]
    assert (said[2].decision, said[2].confidence, len(said[2].required_revisions)) == ("requires_revision", 0.5, 1)


def test_request_bodies(spark):
    bodies = ['{"pmids":["1"]}', '{"pmids":"1"}', '{"pmids":[],"papers":[]}', "{}", '{"papers":["2"],"enableLiteratureSearch":true}', '{"papers":["2"],"queryGene":" G ","enableLiteratureSearch":true}', "no json", '{"pmids":null,"papers":["1"]}']
    got = jobs.validated_json(spark.createDataFrame(list(enumerate(bodies)), "id long, body string")).orderBy("id").collect()
    assert [r.error for r in got] == [None, "papers must be a list", "papers missing", "papers missing", "gene missing", None, "papers missing", None]
    assert got[5].gene == "G" and got[5].papers == ["2"]


def test_roles_meet_entities_only_once(spark):
    """Many reactions over one chain of entities, with a cycle at its end."""
    chain = [(f"e{i}", f"e{i + 1}", "hasComponent") for i in range(12)] + [("e12", "e10", "hasMember")]
    steps = [(f"r{i}", "e0" if i % 2 else "e11", "input" if i % 3 else "regulatedBy") for i in range(30)]
    edges = spark.createDataFrame([("p", f"r{i}", "hasEvent") for i in range(30)] + steps + chain, "src string, dst string, rel string")
    below = {"e0": {f"e{i}" for i in range(13)}, "e11": {"e10", "e11", "e12"}}
    want = {(r, "reactant" if rel == "input" else "regulator", g) for r, first, rel in steps for g in below[first]}
    got = graph.reaction_roles(edges, spark.createDataFrame([("p",)], "pathway string"))
    assert {(r.reaction, r.role, r.gene) for r in got.collect()} == want


def test_tasks_show_the_start_of_a_context(spark):
    row = spark.createDataFrame([("x" * 5000,)], "t string").select(texts.task("review_task", {"curation": F.col("t")}, gene="G", threshold="0.7").alias("p")).first()
    assert row.p.count("x") == 4000


def test_lines_of_a_file_in_many_blocks_are_numbered_densely(spark, tmp_path):
    lines = [f"path {i}\t{'Disease' if i % 3 == 0 else 'Top'}" for i in range(400)]
    (tmp_path / "h.tsv").write_text("Pathway\tTop_Level_Pathway\n" + "\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = files.hierarchy_file(spark, str(tmp_path / "h.tsv")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    kept = [i for i in range(400) if i % 3]
    assert [(r.ord, r.pathway) for r in got] == [(n, f"path {i}") for n, i in reversed(list(enumerate(kept)))]


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("Official Symbol Interactor A\tOfficial Symbol Interactor B\tPublication Source\nA\tB\tPUBMED:1\n")
    assert tuple(files.biogrid_file(spark, str(tmp_path / "b.tsv")).first()) == ("A", "B", "PUBMED:1")
    (tmp_path / "s.json").write_text('{"type":\n"object"}')
    assert json.loads(files.json_text(spark, str(tmp_path / "s.json"))) == {"type": "object"}
    spark.createDataFrame([("1", "x"), ("2", "y")], files.ABSTRACT_SCHEMA).write.parquet(str(tmp_path / "a"))
    some = files.abstract_table(spark, str(tmp_path / "a"), ["2", "3"])
    assert [r.abstract for r in some.collect()] == ["y"] and "PushedFilters: [In(pmid" in some._jdf.queryExecution().toString()
    spark.createDataFrame([("G", {1: 0.9}), ("H", {2: 0.1})], "gene string, combined_score map<int,double>").write.parquet(str(tmp_path / "n"))
    one = files.scored_network_table(spark, str(tmp_path / "n"), "G")
    assert [r.combined_score for r in one.collect()] == [{1: 0.9}] and "EqualTo(gene,G)" in one._jdf.queryExecution().toString()
    lines = spark.createDataFrame([("a",)], "t string")
    files.append_text(lines, str(tmp_path / "t"))
    files.append_text(lines, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    spark.createDataFrame([("P1", 1, "Pathway", "n", None, None)], files.NODE_SCHEMA).write.parquet(str(tmp_path / "g/nodes.parquet"))
    spark.createDataFrame([("P1", "X1", "hasEvent")], files.EDGE_SCHEMA).write.parquet(str(tmp_path / "g/edges.parquet"))
    nodes, edges = files.graph_tables(spark, str(tmp_path / "g"))
    assert graph.bottom_level(nodes, edges).first().bottom and edges.count() == 1
    results = spark.createDataFrame([("A", True, None, 2, 1), ("B", False, 0.5, 0, 0)], "gene string, ok boolean, quality double, instances long, evidence long")
    files.export_batch(results, str(tmp_path / "batch"))
    assert tuple(spark.read.json(str(tmp_path / "batch/summary")).select("total_genes", "successful").first()) == (2, 1)
    assert spark.read.json(str(tmp_path / "batch/results")).first().quality_score == 0.0


def test_indexes_have_a_row_for_each_window(spark):
    events = spark.createDataFrame([(1, "n", None), (2, "m", ""), (3, "o", " ".join("abc"))], "db_id long, name string, summary string")
    got = files.event_index(events, 2, 0).collect()
    assert sorted((r.db_id, r.start_index, len(r.embedding)) for r in got) == [(1, "0", 64), (2, "0", 64), (3, "0", 64), (3, "2", 64)]
    assert files.abstract_index(spark.createDataFrame([("1", "a b c")], "pmid string, abstract string"), 2, 0).count() == 2


def test_tool_states(spark):
    asked = spark.createDataFrame([(1, "7", ""), (2, "8", "G"), (3, "9", "G"), (4, "x.PDF", None)], "id long, pmid string, gene string")
    chunks = spark.createDataFrame([("7", 0, [0.0]), ("7", 1, [90.0]), ("9", 0, None), ("x.PDF", 0, [99.0])], "pmid string, start long, embedding array<double>")
    got = tools.full_text(asked, chunks.select("pmid"), tools.analysed_papers(chunks, [0.0])).orderBy("id").collect()
    assert [(r.gene, r.status, r.n_chunks) for r in got] == [("UNSPECIFIED_GENE", "success", 1), ("G", "skipped", 0), ("G", "failed", 0), ("UNSPECIFIED_GENE", "success", 0)]
    assert got[3].path == "x.PDF"
