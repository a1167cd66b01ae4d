"""Job logs in batch: sequence, pages, states and switches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import parsing

# Identifiers that requests, logs and dashboards share.
PHASES = (
    ("phase_1_literature_extraction", "extractor"),
    ("phase_2_data_model_creation", "curator"),
    ("phase_3_expert_review", "reviewer"),
    ("phase_4_quality_assurance", "qa_checker"),
    ("phase_5_final_consensus", "reviewer"),
)
TOOLS = {
    "extractor": ("literature_search", "fulltext_analysis", "protein_interactions", "evidence_evaluation"),
    "curator": ("graph_query", "schema_validation", "protein_interactions", "evidence_evaluation"),
    "reviewer": ("literature_search", "graph_query", "evidence_evaluation", "quality_metrics", "consistency_check"),
    "qa_checker": ("schema_validation", "consistency_check", "quality_metrics", "graph_query"),
}


def sequenced(events: DataFrame) -> DataFrame:
    """events with a dense 0-based seq per job in (ts, event_id) order."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    return events.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def page(log: DataFrame, since: object = 0, limit: object = 200) -> DataFrame:
    """The rows of each job from since on, at most limit (1 to 1000; 200 if unreadable), with next_since."""

    def number(x: object, otherwise: int) -> int:
        try:
            return int(x)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return otherwise

    first, most = max(0, number(since, 0)), min(1000, max(1, number(limit, 200)))
    rows = log.where((F.col("seq") >= first) & (F.col("seq") < first + most))
    return rows.withColumn("next_since", F.lit(first).cast("long") + F.count("*").over(Window.partitionBy("job_id")))


def state(status: str = "status"):
    """running, done or error of an event status."""
    s = F.col(status)
    return F.when(s == "error", "error").when(s == "end", "done").otherwise("running")


def latest(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by(state(), F.struct("ts", "event_id")).alias("status"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("running", "done", "error")])


def submitted(requests: DataFrame) -> DataFrame:
    """The jobs of validated requests (id, gene, error): running, or rejected where the request breaks a rule."""
    status = F.when(F.col("error").isNull(), "running").otherwise("rejected")
    return requests.select(F.col("id").alias("job_id"), parsing.gene_or_default("gene").alias("gene"), status.alias("status"))


def results(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (job_id) with the status of each job, not_found for one that was never submitted."""
    return asked.join(jobs.select("job_id", "status"), "job_id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def enabled(catalog: DataFrame, names: list[str] | None, column: str) -> DataFrame:
    """The rows whose name is wanted; an empty or missing list wants all."""
    return catalog.where(F.col(column).isin(*names)) if names else catalog


def phase_plan(requests: DataFrame) -> DataFrame:
    """Whether each phase of a request (arrays phases, agents; empty or null is all) runs, or why not."""
    spark = requests.sparkSession
    phases = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(PHASES)], "ord long, phase string, agent string")
    wants = lambda c, x: F.coalesce(F.size(c) == 0, F.lit(True)) | F.array_contains(c, F.col(x))
    outcome = F.when(~wants("phases", "phase"), "skipped: disabled").when(~wants("agents", "agent"), "skipped: no agent").otherwise("run")
    return requests.crossJoin(F.broadcast(phases)).withColumn("outcome", outcome)  # five rows


def validated(requests: DataFrame) -> DataFrame:
    """requests with the error of the first rule it breaks, or null."""
    empty = F.col("pmids").isNull() | (F.size("pmids") == 0)
    named = F.length(F.trim(F.coalesce("gene", F.lit("")))) > 0
    return requests.withColumn("error", F.when(empty & ~F.col("search"), "papers missing").when(F.col("search") & ~named, "gene missing"))


def validated_json(requests: DataFrame, body: str = "body") -> DataFrame:
    """requests with gene, papers and error of a JSON body: papers must be a list, not empty; a search needs a gene.

    papers stand under pmids or, if these are missing or empty, under papers.
    """
    v = F.try_parse_json(F.col(body))
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    listed = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    given = lambda name: kind(name).isNotNull() & (kind(name) != "VOID") & ~((kind(name).startswith("ARRAY")) & (F.size(listed(name)) == 0)) & (F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("x")) != "")
    picked = lambda f: F.when(given("pmids"), f("pmids")).when(given("papers"), f("papers"))
    gene = F.nullif(F.trim(F.try_variant_get(v, "$.queryGene", "string")), F.lit(""))
    search = F.coalesce(F.try_variant_get(v, "$.enableLiteratureSearch", "boolean"), F.lit(False))
    error = (
        F.when(picked(lambda n: ~kind(n).startswith("ARRAY")), "papers must be a list")
        .when(F.coalesce(F.size(picked(listed)), F.lit(0)) <= 0, "papers missing")
        .when(search & gene.isNull(), "gene missing")
    )
    return requests.withColumn("gene", gene).withColumn("papers", picked(listed)).withColumn("error", error)


def metadata(runs: DataFrame) -> DataFrame:
    """run, papers_processed, pathways_created and quality, all counted: runs has papers, pathways and scores.

    Papers count as requested, whatever a cap took of them; a missing quality score is 0.
    """
    return runs.select(
        "run",
        F.coalesce(F.size("papers"), F.lit(0)).cast("long").alias("papers_processed"),
        F.coalesce(F.size("pathways"), F.lit(0)).cast("long").alias("pathways_created"),
        quality_of("scores").alias("quality"),
    )


def quality_of(scores: str):
    """The overall quality of a map of scores, 0 where it is missing."""
    return F.coalesce(F.try_element_at(F.col(scores), F.lit("overall_quality")), F.lit(0.0))


def dashboard(spark) -> dict[str, DataFrame]:
    """The phases, agents and tools that requests may switch on or off, as three small tables."""
    phases = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(PHASES)], "ord long, phase string, agent string")
    agents = spark.createDataFrame([(i, a, len(t)) for i, (a, t) in enumerate(TOOLS.items())], "ord long, agent string, n_tools long")
    return {"phases": phases, "agents": agents, "tools": tool_table(spark)}


def kept_fields(attrs: str = "attrs"):
    """The fields of an event that are not null."""
    return F.map_filter(attrs, lambda k, v: v.isNotNull())


def roll_up(runs: DataFrame, key: str = "gene") -> DataFrame:
    """Per key the runs attempted and successful (ok), the best quality of these, and whether there is one."""
    ok = F.col("ok")
    return runs.groupBy(key).agg(F.count("*").alias("attempted"), F.count_if(ok).alias("successful"), F.round(F.max(F.when(ok, F.col("quality"))), 2).alias("best"), F.coalesce(F.max(F.when(ok, 1)), F.lit(0)).cast("long").alias("any_success"))


def tool_table(spark) -> DataFrame:
    """agent, ord, tool of every agent."""
    return spark.createDataFrame([(a, i, t) for a, tools in TOOLS.items() for i, t in enumerate(tools)], "agent string, ord long, tool string")


def workflow_branch(requests: DataFrame) -> DataFrame:
    """requests (search, gene, papers, fulltext) with the number of the extraction workflow that applies.

    1, 2: search with and without full text; 3, 4: a search without a gene falls back to given papers; 5, 6: given
    papers only; 7: no source.
    """
    gene = F.length(F.trim(F.coalesce("gene", F.lit("")))) > 0
    full = lambda yes, no: F.when(F.col("fulltext"), yes).otherwise(no)
    branch = F.when(F.col("search") & gene, full(1, 2)).when(F.col("papers") & F.col("search"), full(3, 4)).when(F.col("papers"), full(5, 6)).otherwise(7)
    return requests.withColumn("branch", branch.cast("long"))


def tool_status(calls: DataFrame, payload: str = "payload", raised: str = "raised") -> DataFrame:
    """calls with end or error: an exception, or a JSON payload whose status is failed or error."""
    said = F.try_variant_get(F.try_parse_json(F.col(payload)), "$.status", "string")
    return calls.withColumn("outcome", F.when(F.col(raised) | F.coalesce(said.isin("failed", "error"), F.lit(False)), "error").otherwise("end"))


def transitions(events: DataFrame, timeout_ms: int, until: int | None = None) -> DataFrame:
    """job_id, event_id, outcome and status of events (job_id, event_id, ts, status), as the state machine of the job
    stream gives them (streaming.job_states says what they mean).

    until is the time, in milliseconds, up to which silence counts; without it a job is never timed out after its last
    event. All is windows over a job's events in order, so a hot job is sorted on disk, not held in memory.
    """
    order = Window.partitionBy("job_id").orderBy("ms", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = F.col("status").isin("end", "error")
    rows = events.where(F.col("job_id").isNotNull()).select("job_id", "event_id", "status", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    rows = rows.withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("begun", F.min(F.when(F.col("status") == "start", F.col("nth"))).over(so_far))
    counts = (F.col("nth") == F.col("begun")) | (F.col("nth") > F.col("begun")) & (F.col("status") != "start")
    rows = rows.withColumn("counts", F.coalesce(counts, F.lit(False)))
    # Of the events that count: the one before, and whether the job had ended or fallen silent by then.
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("counts"), F.struct("nth", "ms", closing.alias("closing")))).over(before)
    rows = rows.withColumn("last", last).withColumn("late", F.coalesce(F.col("ms") > F.col("last.ms") + timeout_ms, F.lit(False)))
    ended = F.col("counts") & (F.col("late") | F.coalesce(F.col("last.closing"), F.lit(False)))
    rows = rows.withColumn("closed", F.max(F.when(F.col("counts"), ended).otherwise(False)).over(so_far))
    accepted = F.col("counts") & ~F.col("closed")
    own = F.when(F.col("nth") == F.col("begun"), "submitted").when(F.col("status") == "end", "done").when(F.col("status") == "error", "error").otherwise("running")
    rows = rows.withColumn("accepted", accepted).withColumn("own", F.when(accepted, own))
    # A job is silent at its first event that comes too late, or at the end; the row says what it was silent after.
    kept = F.last("own", ignorenulls=True).over(so_far)
    final = F.max(F.when(F.col("accepted"), F.struct("nth", "ms", "own"))).over(Window.partitionBy("job_id"))
    rows = rows.withColumn("held", kept).withColumn("final", final)
    silent = F.col("final.own").isin("submitted", "running")
    gone = silent & (F.col("ms") > F.col("final.ms") + timeout_ms)
    outcome = F.when(F.col("accepted"), "accepted").when(F.col("begun").isNull(), "early").when(F.col("status") == "start", "repeated").otherwise("closed")
    each = rows.select("job_id", "event_id", outcome.alias("outcome"), F.when(gone, "timeout").otherwise(F.col("held")).alias("status"))
    end = F.max("ms").over(Window.partitionBy("job_id"))
    until_ = end if until is None else F.greatest(end, F.lit(until))
    timed = rows.withColumn("end", until_).where(F.col("accepted") & (F.col("nth") == F.col("final.nth")) & silent & (F.col("end") > F.col("ms") + timeout_ms))
    return each.unionByName(timed.select("job_id", F.lit(None).cast("long").alias("event_id"), F.lit("timeout").alias("outcome"), F.lit("timeout").alias("status")))
