"""What is dealt out once is not dealt out again row by row."""

import re

from pyspark.sql import functions as F

from strandlake.operators import enrichment, graph, paths


def _exchanges(df) -> list[list[str]]:
    """The columns of every hash exchange of the plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", x) for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


def test_hits_travel_as_lists(spark):
    partners = spark.createDataFrame([(1, 5, [7]), (1, 6, [7, 8]), (2, 6, [9])], "query_gene long, partner long, pmids array<long>")
    sets = spark.createDataFrame([(10, 5), (10, 6), (11, 6), (11, 6)], "pathway_id long, gene long")
    mapped, counted = enrichment.hits(partners, sets), enrichment.hit_counts(partners, sets)
    got = {(r.query_gene, r.pathway_id): (r.overlap_count, [(m.partner, m.pmids) for m in r.mapped]) for r in mapped.collect()}
    assert got == {(1, 10): (2, [(5, [7]), (6, [7, 8])]), (1, 11): (1, [(6, [7, 8])]), (2, 10): (1, [(6, [9])]), (2, 11): (1, [(6, [9])])}
    assert {(r.query_gene, r.pathway_id): (r.overlap_count, r.n_publications) for r in counted.collect()} == {k: (n, sum(len(p) for _, p in m)) for k, (n, m) in got.items()}
    assert all(["query_gene", "pathway_id"] != x for df in (mapped, counted) for x in _exchanges(df))


def test_roles_travel_as_lists(spark):
    rows = [("X1", "A", "input"), ("X1", "B", "input"), ("X2", "B", "regulatedBy"), ("A", "C", "hasMember"), ("B", "C", "hasComponent"), ("C", "B", "hasCandidate")]
    edges = spark.createDataFrame(rows, "src string, dst string, rel string")
    got = graph.participation(edges, spark.createDataFrame([("X1",), ("X2",)], "reaction string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([("X1", "reactant", n) for n in "ABC"] + [("X2", "regulator", n) for n in "BC"])
    assert all("node" not in x or "reaction" not in x for x in _exchanges(got))


def test_a_typed_first_step_forms_no_paths_from_the_start(spark, monkeypatch):
    rows = [("X1", "A", "input"), ("X2", "A", "regulatedBy"), ("A", "B", "hasMember"), ("B", "C", "hasComponent")]
    edges = spark.createDataFrame(rows, "src string, dst string, rel string")
    ends = spark.createDataFrame([("B",), ("C",)], "node string")
    closed, reach = [], paths.reach
    monkeypatch.setattr(paths, "reach", lambda steps, ends: closed.append(reach(steps, ends)) or closed[-1])
    got = paths._joined(edges, ends, paths.Hop(graph.PARTICIPATION, "entity", (), many=True, first="role"))
    starts = sorted(tuple(r) for r in got.where(F.col("src").like("X%")).collect())
    assert starts == [("X1", "B", "input"), ("X1", "C", "input"), ("X2", "B", "regulatedBy"), ("X2", "C", "regulatedBy")]
    assert {r.src for r in closed[0].collect()} == {"A", "B"}
