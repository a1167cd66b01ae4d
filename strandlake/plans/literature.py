"""Registered queries of the literature side (boolean search, partners by source, models asked once) of job states and of record schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import schema_native, texts
from strandlake.operators import jobs, models, network, search
from strandlake.plans.catalog import render_sql, stub_sql
from strandlake.plans.fixtures import Inputs
from strandlake.plans.registry import query
from strandlake.session import kept

_SINCE, _UNTIL = "1992-06-01", "1998-03-31"

#: Every text scanned for every request: words between double blanks, so that neighbours don't share a blank. A phrase is
#: counted at every place, as those of one word twice overlap.
_SCAN = r"""tok as (select pmid, regexp_extract_all(lower(abstract), '[\p{L}\p{N}]+') as w, concat(' ', array_to_string(regexp_extract_all(lower(abstract), '[\p{L}\p{N}]+'), '  '), ' ') as t from {dated_abstracts} where published between date '{since}' and date '{until}'),
ask as (select id, list_distinct(list_concat(regexp_extract_all(lower(a), '[\p{L}\p{N}]+'), regexp_extract_all(lower(b), '[\p{L}\p{N}]+'))) as ab, regexp_extract_all(lower(c), '[\p{L}\p{N}]+') as c, regexp_extract_all(lower(d), '[\p{L}\p{N}]+') as dl, concat(' ', array_to_string(regexp_extract_all(lower(d), '[\p{L}\p{N}]+'), '  '), ' ') as d from {boolean_searches}),
m as (select id, pmid, list_transform(ab, lambda w: (length(t) - length(replace(t, concat(' ', w, ' '), '')))::bigint // (length(w) + 2)) as nab, list_transform(c, lambda w: (length(t) - length(replace(t, concat(' ', w, ' '), '')))::bigint // (length(w) + 2)) as nc,
  len(list_filter(range(1, len(w) - len(dl) + 2), lambda k: w[k:k + len(dl) - 1] = dl)) as nd from ask, tok where contains(t, d)),
s as (select id, pmid, case when list_min(nab) > 0 then list_sum(nab) else 0 end + case when list_min(nc) > 0 then list_sum(nc) else 0 end as n, nd from m),
r as (select id, pmid, (n + nd)::bigint as hits, row_number() over (partition by id order by n + nd desc, pmid::bigint) as rank from s where n > 0)""".replace("{since}", _SINCE).replace("{until}", _UNTIL)


@query(f"with {_SCAN} select id, pmid, hits, rank from r where rank <= 8")
def search_boolean(i: Inputs) -> DataFrame:
    """`(a b OR c) AND "d e"` for every request at once, within a range of dates."""
    index = kept(search.positions(i.dated_abstracts))
    return search.search_boolean(index, i.boolean_searches.select("id", "term"), _SINCE, _UNTIL)


# --- sources of interactions ---------------------------------------------------------------------------------------

_BOTH = "b as (select gene_a as gene, gene_b as partner from {fi} where score > 0.9 union select gene_b, gene_a from {fi} where score > 0.9)"


@query(f"with {_BOTH} select gene, partner, 0::bigint as n_publications from b")
def scored_partners(i: Inputs) -> DataFrame:
    """Partners by the scored network alone, from either end of an edge."""
    found = network.choose_source("scored_network", network.edges(i.ppi_intact), i.fi, 0.9)
    return found.select("gene", "partner", F.size("pmids").cast("long").alias("n_publications"))


@query("with u as (select gene_a as gene, gene_b as partner, pmid from {ppi_intact} union select gene_b, gene_a, pmid from {ppi_intact} union select gene_a, gene_b, pmid from {ppi_biogrid} union select gene_b, gene_a, pmid from {ppi_biogrid}) select gene, partner, count(*) as n_publications from u group by gene, partner")
def unfiltered_partners(i: Inputs) -> DataFrame:
    """Partners by the interaction files alone, the scored network left out."""
    found = network.choose_source("intact_biogrid", network.edges(i.ppi_intact, i.ppi_biogrid), i.fi, use_filter=False)
    return found.select("gene", "partner", F.size("pmids").cast("long").alias("n_publications"))


# --- models --------------------------------------------------------------------------------------------------------


@query(f"""select a.pmid, {stub_sql(render_sql("abstract_match", text="a.abstract"))} as answer, null::varchar as answer_error, count(*) over (partition by coalesce(a.abstract, '')) as n_same from {{abstracts}} a""")
def answers_once(i: Inputs) -> DataFrame:
    """A model's answer on every abstract; copies of an abstract are one call, whose answer all of them get."""
    prompts = i.abstracts.withColumn("prompt", texts.render("abstract_match", text=F.col("abstract")))
    same = prompts.groupBy(F.sha2(F.coalesce("prompt", F.lit("")).cast("binary"), 256).alias("d")).agg(F.count("*").alias("n_same"))
    out = models.ask_once(prompts, "prompt").withColumn("d", F.sha2(F.coalesce("prompt", F.lit("")).cast("binary"), 256))
    return out.join(same, "d").select("pmid", "answer", "answer_error", "n_same")


# --- job states ----------------------------------------------------------------------------------------------------

#: Half a day without an event that counts.
_SILENCE = 43_200_000


@query(
    f"""with e as (select job_id, event_id, status, epoch_ms(ts) as ms, row_number() over (partition by job_id order by epoch_ms(ts), event_id) as n from {{job_events}} where job_id is not null),
f(job_id, n, event_id, outcome, state, last, timed) as (
  select distinct job_id, 0::bigint, null::bigint, null::varchar, null::varchar, null::bigint, false from e
  union all
  select job_id, n, event_id, outcome, case when outcome <> 'accepted' then s0 when s0 is null then 'submitted' when status = 'end' then 'done' when status = 'error' then 'error' else 'running' end, case when outcome = 'accepted' then ms else last end, timed
  from (select *, case when s0 is null then case when status = 'start' then 'accepted' else 'early' end when status = 'start' then 'repeated' when s0 in ('submitted', 'running') then 'accepted' else 'closed' end as outcome
    from (select e.*, f.last, coalesce(f.state in ('submitted', 'running') and e.ms > f.last + {_SILENCE}, false) as timed, case when f.state in ('submitted', 'running') and e.ms > f.last + {_SILENCE} then 'timeout' else f.state end as s0
      from f join e on e.job_id = f.job_id and e.n = f.n + 1) g) h)
select job_id, event_id, outcome, state as status from f where n > 0 union all select job_id, null, 'timeout', 'timeout' from f where timed""",
    recursive=True,
)
def job_transitions(i: Inputs) -> DataFrame:
    """What each event does to the state of its job, and the jobs that fell silent."""
    return jobs.transitions(i.job_events, _SILENCE)


# --- record schemas ------------------------------------------------------------------------------------------------

_SCHEMA = {
    "type": "object",
    "properties": {
        "entities": {"type": "array", "maxItems": 2, "items": {"anyOf": [{"$ref": "#/$defs/named"}, {"required": ["class"]}]}},
        "reactions": {"items": {"oneOf": [{"required": ["class"]}, {"properties": {"displayName": {"type": "null"}}}]}},
        "pathways": {"type": "array", "items": {"type": "object", "additionalProperties": {"type": "string", "pattern": "^b"}}},
    },
    "$defs": {"named": {"type": "object", "required": ["displayName"], "properties": {"displayName": {"type": "string", "maxLength": 6}}}},
}


@query("""select s_suppkey as batch_id, concat_ws('|', case when s_acctbal < 0 then '$.entities: too many items' end, case when s_nationkey >= 12 then concat('$.entities[', case when s_acctbal < 0 then '2' else '1' end, ']: fits none of the alternatives') end,
case when s_acctbal > 5000 then '$.reactions[0]: fits 2 of the alternatives, not one' end, case when s_nationkey < 20 then '$.pathways[0].displayName: does not match the pattern' end) as errors from {supplier}""")
def schema_report(i: Inputs) -> DataFrame:
    """Violations of a schema with alternatives, references and patterns, as a native expression."""
    return i.batches.select("batch_id", F.array_join(schema_native.compiled(_SCHEMA)("doc"), "|").alias("errors"))
