import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandlake.functions import decisions, parsing, texts, vectors
from strandlake.operators import evidence, graph, jobs, models
from strandlake.sources import files
from strandlake.streaming import job_log


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b", "hasEvent"), ("b", "c", "hasEvent"), ("c", "a", "hasEvent"), ("c", "d", "other")], "src string, dst string, rel string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert sorted(r.node for r in graph.descendants(roots, e).collect()) == ["a", "b", "c"]


def test_roles_keep_the_first_step(spark):
    e = spark.createDataFrame(
        [("p", "r", "hasEvent"), ("r", "x", "input"), ("r", "y", "regulatedBy"), ("x", "z", "hasMember"), ("z", "x", "hasMember"), ("y", "z", "hasComponent"), ("r", "q", "unrelated")], "src string, dst string, rel string"
    )
    got = {(r.role, r.gene) for r in graph.reaction_roles(e, spark.createDataFrame([("p",)], "pathway string")).collect()}
    assert got == {("reactant", "x"), ("reactant", "z"), ("regulator", "y"), ("regulator", "z"), ("regulator", "x")}
    only = graph.reaction_roles(e, spark.createDataFrame([("p",)], "pathway string"), spark.createDataFrame([("y",)], "gene string"))
    assert [(r.role, r.gene) for r in only.collect()] == [("regulator", "y")]


def test_topics_and_names(spark):
    topics = spark.createDataFrame([(1, "B"), (1, "A"), (2, "X")], "event long, topic string")
    events = spark.createDataFrame([(1,), (2,), (3,)], "event long")
    assert {r.event: r.topic for r in graph.topic_pick(topics, events, ("X", "A")).collect()} == {1: "B", 2: "unknown", 3: "unknown"}
    nodes = spark.createDataFrame([("n", 1), ("n", 5), ("m", 2)], "name string, db_id long")
    assert [tuple(r) for r in graph.name_to_id(nodes, spark.createDataFrame([("n",)], "name string")).collect()] == [("n", 5)]
    assert graph.summaries(spark.createDataFrame([(1, "a"), (2, "b")], "db_id long, name string"), spark.createDataFrame([(1, "s")], "db_id long, summary string"), 1).collect()[0].summary == "s"


def test_vectors_and_windows(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in v.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] is None
    text = spark.createDataFrame([(" ".join(map(str, range(30))),), ("",), (None,)], "t string")
    chunks = vectors.token_windows(text, "t", 12, 2).where("t <> ''").orderBy("start").select("start", "chunk").collect()
    assert [c.start for c in chunks] == [0, 10, 20] and chunks[-1].chunk.split() == [str(i) for i in range(20, 30)]
    assert {int(x) for c in chunks for x in c.chunk.split()} == set(range(30))


def test_mean_and_maximum_scores(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0])], "p long, embedding array<float>")
    right = spark.createDataFrame([("d", [1.0, 0.0]), ("d", [1.0, 1.0])], "d string, embedding array<float>")
    assert evidence.pair_scores(left, right, ("p", "d")).first().score == pytest.approx((1 + 0 + 2 * 2**-0.5) / 4)
    assert evidence.pair_scores(left, right, ("p", "d"), "max").first().score == pytest.approx(1.0)


def test_ranking_keeps_missing_scores_last(spark):
    rows = spark.createDataFrame([("p", "1", 0.5, None), ("p", "2", 0.5, 4), ("p", "3", 0.4, 9), ("p", "4", 0.9, 2), ("p", "5", 0.39, 9)], "pathway string, pmid string, cos_score double, llm_score long")
    assert [r.pmid for r in evidence.rank_evidence(rows).orderBy("rank").collect()] == ["2", "1", "3"]
    few = spark.createDataFrame([("g", str(i), float(i)) for i in range(9)] + [("h", "1", 0.3)], "g string, pmid string, score double")
    got = evidence.select_for_interactions(few, "g").collect()
    assert sorted(r.pmid for r in got if r.g == "g") == [str(i) for i in range(1, 9)] and [r.score for r in got if r.g == "h"] == [None]


def test_evidence_rules(spark):
    rows = spark.createDataFrame([("a b c d e f", "A B C D E F"), ("", "x"), (None, "x")], "t string, r string")
    got = [r.e for r in rows.select(decisions.evidence(F.col("t"), F.col("r")).alias("e")).collect()]
    assert (got[0].overlap, got[0].score, got[0].strength, got[0].recommendation) == (6, 5, "medium", "review")
    assert (got[1].score, got[1].recommendation) == (0, "reject")


def test_consensus_ignores_vote_order_and_unsure_rejections(spark):
    votes = [("g", "approve", 0.9), ("g", "reject", 0.6), ("g", "requires_revision", 0.5), ("h", "reject", 0.7), ("h", "approve", 1.0), ("i", "approve", 0.1)]
    for order in (votes, votes[::-1]):
        got = {r.gene: r.decision for r in decisions.consensus(spark.createDataFrame(order, "gene string, decision string, confidence double")).collect()}
        assert got == {"g": "requires_revision", "h": "reject", "i": "approve"}


def test_missing_is_not_null(spark):
    rows = spark.createDataFrame([(1, '{"entities":[{"class":null,"displayName":"x"},{"displayName":"y"}],"reactions":[{}]}'), (2, "no json")], "batch_id long, doc string")
    got = sorted((r.part, r.position, r.missing) for r in decisions.structural_errors(rows).collect())
    assert got == [("entities", 1, "class"), ("reactions", 0, "class"), ("reactions", 0, "displayName")]
    assert [tuple(r) for r in decisions.instance_counts(rows).orderBy("batch_id").collect()] == [(1, 2, 1, 0, 3), (2, 0, 0, 0, 0)]


def test_loose_answers(spark):
    rows = spark.createDataFrame([("[]",), ("{}",), ("[1]",), ("word",), (None,)], "t string")
    got = [(r.r.kind, r.r.records, r.v.decision) for r in rows.select(parsing.loose_records("t").alias("r"), parsing.vote_of("t").alias("v")).collect()]
    assert got == [("array", 0, "unknown"), ("object", 1, "unknown"), ("array", 1, "unknown"), ("raw_text", 1, "unknown"), ("raw_text", 1, "unknown")]


def _events(n=60):
    start = dt.datetime(2024, 1, 1)
    return [(i % 7, i, start + dt.timedelta(seconds=i // 2), "tool", ["running", "end", "error"][i % 3], {"a": None, "b": "1"}) for i in range(n)]


def test_pages_and_states(spark):
    log = jobs.sequenced(spark.createDataFrame(_events(), job_log.EVENT_SCHEMA))
    per_job = log.groupBy("job_id").agg(F.max("seq").alias("m"), F.count_distinct("seq").alias("n")).collect()
    assert all(r.n == r.m + 1 for r in per_job)
    assert {r.next_since for r in jobs.page(log, 2, 3).collect()} == {5}
    assert jobs.page(log, "x", "y").count() == 60 and jobs.page(log, -4, 0).count() == 7
    assert sum(jobs.status_counts(jobs.latest(log)).first()[1:]) == 7


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame(_events(), job_log.EVENT_SCHEMA)
    for k in range(3):
        events.where((F.col("event_id") >= 20 * k) & (F.col("event_id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = job_log.sequenced(job_log.emitted(job_log.read_events(spark, str(tmp_path / "in"))))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.job_id, r.seq): r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.job_id, r.seq): r.event_id for r in jobs.sequenced(events).collect()}
    last = job_log.latest(job_log.emitted(job_log.read_events(spark, str(tmp_path / "in"))))
    last.writeStream.format("memory").queryName("latest_jobs").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    assert {r.job_id: r.status for r in spark.table("latest_jobs").collect()} == {r.job_id: r.status for r in jobs.latest(events).collect()}


def test_null_attributes_leave_the_log(spark):
    got = job_log.emitted(spark.createDataFrame([*_events(1), (None, 9, None, "x", "y", None)], job_log.EVENT_SCHEMA)).collect()
    assert [r.attrs for r in got] == [{"b": "1"}]


def test_switches(spark):
    assert jobs.enabled(jobs.tool_table(spark), [], "tool").count() == 17
    rows = spark.createDataFrame([(["a"], "G", False), (None, "G", False), ([], " ", True), (None, "G", True)], "pmids array<string>, gene string, search boolean")
    assert [r.error for r in jobs.validated(rows).collect()] == [None, "papers missing", "gene missing", None]
    calls = spark.createDataFrame([('{"status":"failed"}', False), ("x", False), (None, True)], "payload string, raised boolean")
    assert [r.outcome for r in jobs.tool_status(calls).collect()] == ["error", "end", "error"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("Alias(es) interactor A\tAlias(es) interactor B\tPublication Identifier(s)\nuniprotkb:A(gene name)\tuniprotkb:B(gene name)\tpubmed:1\n")
    assert tuple(files.intact_file(spark, str(tmp_path / "i.tsv")).first())[2] == "pubmed:1"
    (tmp_path / "h.tsv").write_text("Pathway\tTop_Level_Pathway\na\tX\nb\tDisease\nc\tY\n")
    assert [r.pathway for r in files.hierarchy_file(spark, str(tmp_path / "h.tsv")).collect()] == ["c", "a"]
    (tmp_path / "p.tsv").write_text("pathway_id\tpathway_name\tgenes\n1\tP\tA,B\n")
    assert files.pathway_file(spark, str(tmp_path / "p.tsv")).first().genes == "A,B"
    (tmp_path / "g.txt").write_text(" A \nB\n")
    assert [r.gene for r in files.gene_list_file(spark, str(tmp_path / "g.txt")).collect()] == ["A", "B"]
    papers = tmp_path / "papers"
    papers.mkdir()
    for name in ("12.pdf", "x1.pdf", "7.txt"):
        (papers / name).write_bytes(b"one two three")
    library = files.pdf_library(spark, str(papers))
    assert [tuple(r) for r in library.collect()] == [("12", 13)]
    assert {r.pmid: r.exists for r in files.pdf_present(library, spark.createDataFrame([("12",), ("9",)], "pmid string")).collect()} == {"12": True, "9": False}
    chunks = files.paper_chunks(spark, str(papers / "12.pdf"), lambda b: b.decode())
    assert [tuple(r) for r in chunks.collect()] == [("12", 0, "one two three")]
    files.save_vector_index(spark.createDataFrame([(1, "n", None, [1.0])], "db_id long, display_name string, start_index long, embedding array<float>"), str(tmp_path / "v"))
    assert files.vector_index(spark, str(tmp_path / "v")).first().start_index == "-1"
    results = spark.createDataFrame([("A", True, None, 2, 1), ("B", False, 0.5, 0, 0)], "gene string, ok boolean, quality double, instances long, evidence long")
    totals, each = files.batch_summary(results)
    assert tuple(totals.first()) == (2, 1) and [(r.gene, r.quality_score) for r in each.collect()] == [("A", 0.0)]
    files.export_json(results, str(tmp_path / "j"))
    files.export_csv(results, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_model_stages(spark):
    rows = spark.createDataFrame([("a",), (None,)], "t string")
    asked = models.ask(rows.select(texts.render("relationships", text=F.col("t")).alias("p")), "p").collect()
    assert all("score: " in r.answer for r in asked) and asked == models.ask(rows.select(texts.render("relationships", text=F.col("t")).alias("p")), "p").collect()
    assert len(models.embed(rows, "t").first().embedding) == 64
    said = spark.createDataFrame([("x\n A - binds -> B \nA -> B",)], "t string")
    assert [tuple(r) for r in said.select(F.explode(texts.relationships(F.col("t"))).alias("r")).select("r.*").collect()] == [("A", "binds", "B")]
