"""Stand-in inputs over the base tables, defined once as SQL for Spark and for the oracles.

{name} is a base table or another view; {S} is the engine's string type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import parts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "membership": "select distinct o.o_custkey as pathway_id, l.l_partkey as gene from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey",
    "pathway_rows": "select o.o_custkey as pathway_id, concat('Pathway ', cast(o.o_custkey as {S})) as pathway_name, l.l_partkey as gene from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey",
    "pair": "select distinct a.l_partkey as ga, b.l_partkey as gb, a.l_orderkey as pub, a.l_returnflag as fa, b.l_returnflag as fb from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey where a.l_partkey < b.l_partkey",
    "ppi_intact": "select distinct ga as gene_a, gb as gene_b, pub as pmid from {pair} where fa <> 'R' and fb <> 'R'",
    "ppi_biogrid": "select distinct ga as gene_a, gb as gene_b, pub as pmid from {pair} where fa <> 'A' and fb <> 'A'",
    "intact_raw": """select concat('psi-mi:p', cast(gene_a as {S}), '(display_long)|uniprotkb:G', cast(gene_a as {S}), '(gene name)') as alias_a,
        case when gene_b % 17 = 0 then 'psi-mi:none(display_long)' else concat('uniprotkb:X(gene name synonym)|uniprotkb:G', cast(gene_b as {S}), '(gene name)') end as alias_b,
        case when pmid % 13 = 0 then concat('imex:IM-', cast(pmid as {S})) else concat('imex:IM-', cast(pmid as {S}), '|pubmed:', cast(pmid as {S})) end as pubs from {ppi_intact}""",
    "biogrid_raw": "select concat('G', cast(gene_a as {S})) as symbol_a, case when gene_b % 19 = 0 then '' else concat('G', cast(gene_b as {S})) end as symbol_b, case when pmid % 11 = 0 then concat('DOI:', cast(pmid as {S})) else concat('PUBMED:', cast(pmid as {S})) end as source from {ppi_biogrid}",
    "fi": "select gene_a, gene_b, cast(((gene_a + gene_b) * 7919) % 1000 as double) / 1000 as score from (select gene_a, gene_b from {ppi_intact} union select gene_a, gene_b from {ppi_biogrid}) u",
    "abstracts": "select cast(doc_id as {S}) as pmid, text as abstract from {documents}",
    "llm_replies": "select cast(doc_id as {S}) as pmid, case when doc_id % 11 = 0 then 'no number given' else concat('**score: ', cast((doc_id * 7) % 10 + 1 as {S}), '**') end as reply from {documents}",
    "abstract_chunks": "select cast(floor(vec_id / 5) as bigint) as doc, vec_id % 5 as chunk, embedding from {embeddings} where vec_id >= 50",
    "pathway_chunks": "select cast(label as bigint) as pathway, vec_id, embedding from {embeddings} where vec_id < 50",
    "edges": """select concat('R', cast(n_regionkey as {S})) as src, concat('N', cast(n_nationkey as {S})) as dst, 'hasEvent' as rel from {nation}
        union all select concat('N', cast(c_nationkey as {S})), concat('P', cast(c_custkey as {S})), 'hasEvent' from {customer}
        union all select concat('P', cast(o_custkey as {S})), concat('X', cast(o_orderkey as {S})), 'hasEvent' from {orders}
        union all select distinct concat('X', cast(l_orderkey as {S})), concat('E', cast(l_partkey as {S})),
            case l_returnflag when 'A' then 'input' when 'N' then 'catalystActivity' else 'regulatedBy' end from {lineitem}
        union all select concat('E', cast(p_partkey as {S})), concat('E', cast(cast(floor(p_partkey / 10) as bigint) as {S})), 'hasMember' from {part} where p_partkey > 0""",
    "complex_edges": """select concat('P', cast(o_custkey as {S})) as src, concat('X', cast(o_orderkey as {S})) as dst, 'hasEvent' as rel from {orders}
        union all select distinct concat('X', cast(l_orderkey as {S})), concat('C', cast(l_suppkey as {S})), case l_linenumber when 1 then 'input' when 2 then 'catalystActivity' when 3 then 'regulatedBy' else 'physicalEntity' end from {lineitem}
        union all select concat('C', cast(s_suppkey as {S})), concat('M', cast(s_nationkey as {S})), 'hasComponent' from {supplier}
        union all select concat('M', cast(n_nationkey as {S})), concat('L', cast(n_regionkey as {S})), 'hasMember' from {nation}
        union all select concat('L', cast(n_regionkey as {S})), concat('M', cast(n_nationkey as {S})), 'hasCandidate' from {nation}""",
    "typed_edges": """select concat('R', cast(n_regionkey as {S})) as src, concat('N', cast(n_nationkey as {S})) as dst, 'hasEvent' as rel from {nation}
        union all select concat('N', cast(c_nationkey as {S})), concat('P', cast(c_custkey as {S})), 'hasEvent' from {customer}
        union all select concat('P', cast(a.c_custkey as {S})), concat('P', cast(b.c_custkey as {S})), 'hasEvent' from {customer} a join {customer} b on b.c_custkey = a.c_custkey + 1 where a.c_custkey % 4 <> 3
        union all select concat('P', cast(o_custkey as {S})), concat('X', cast(o_orderkey as {S})), 'hasEvent' from {orders}
        union all select concat('X', cast(l_orderkey as {S})), concat('E', cast(l_partkey as {S})), 'input' from {lineitem} where l_returnflag = 'A' and l_linenumber <= 2
        union all select concat('X', cast(l_orderkey as {S})), concat('K', cast(l_orderkey as {S})), 'catalystActivity' from {lineitem} where l_returnflag = 'N' and l_linenumber = 1
        union all select concat('K', cast(l_orderkey as {S})), concat('C', cast(l_suppkey as {S})), 'physicalEntity' from {lineitem} where l_returnflag = 'N' and l_linenumber = 1
        union all select concat('X', cast(l_orderkey as {S})), concat('D', cast(l_suppkey % 25 as {S})), 'regulatedBy' from {lineitem} where l_returnflag = 'R' and l_linenumber = 1
        union all select concat('D', cast(s_nationkey as {S})), concat('C', cast(s_suppkey as {S})), 'hasMember' from {supplier} where s_suppkey % 50 = 0
        union all select concat('D', cast(n_nationkey as {S})), concat('D', cast(n_nationkey + 1 - 2 * (n_nationkey % 2) as {S})), 'hasCandidate' from {nation} where n_nationkey < 24
        union all select concat('C', cast(s_suppkey as {S})), concat('C', cast(cast(floor(s_suppkey / 10) as bigint) as {S})), 'hasComponent' from {supplier} where s_suppkey >= 10
        union all select concat('C', cast(s_suppkey as {S})), concat('E', cast(p_partkey as {S})), 'hasComponent' from {supplier} join {part} on p_partkey % 37 = s_suppkey % 37 where p_size <= 1
        union all select concat('E', cast(p_partkey as {S})), concat('Q', cast(cast(floor(p_partkey / 2) as bigint) as {S})), 'referenceEntity' from {part}""",
    "typed_nodes": """select concat('R', cast(r_regionkey as {S})) as node, cast(r_regionkey as bigint) as db_id, 'TopLevelPathway' as label, r_name as name, cast(null as {S}) as genes from {region}
        union all select concat('N', cast(n_nationkey as {S})), cast(n_nationkey as bigint), 'Pathway', n_name, null from {nation}
        union all select concat('P', cast(c_custkey as {S})), c_custkey, 'Pathway', concat(c_mktsegment, ' ', cast(c_nationkey as {S})), null from {customer}
        union all select concat('X', cast(o_orderkey as {S})), o_orderkey, case when o_orderkey % 9 = 4 then 'FailedReaction' else 'ReactionLikeEvent' end, concat('Reaction ', cast(o_orderkey as {S})), null from {orders}
        union all select distinct concat('K', cast(l_orderkey as {S})), l_orderkey, 'CatalystActivity', 'catalyst', null from {lineitem} where l_returnflag = 'N' and l_linenumber = 1
        union all select concat('C', cast(s_suppkey as {S})), s_suppkey, 'Complex', s_name, null from {supplier}
        union all select concat('D', cast(n_nationkey as {S})), cast(n_nationkey as bigint), 'DefinedSet', n_name, null from {nation}
        union all select concat('E', cast(p_partkey as {S})), p_partkey, case when p_partkey % 17 = 5 then 'SimpleEntity' else 'EntityWithAccessionedSequence' end, p_name, null from {part}
        union all select distinct concat('Q', cast(cast(floor(p_partkey / 2) as bigint) as {S})), cast(floor(p_partkey / 2) as bigint), case when floor(p_partkey / 2) % 13 = 3 then 'ReferenceMolecule' else 'ReferenceSequence' end, 'reference',
            case when floor(p_partkey / 2) % 19 <> 7 then concat('G', cast(cast(floor(p_partkey / 2) as bigint) as {S}), ',ALIAS', cast(cast(floor(p_partkey / 2) as bigint) as {S})) end from {part}""",
    "typed_requests": """select p_partkey as id, concat('G', cast(cast(floor(p_partkey / 2) as bigint) as {S})) as gene, case when p_size <= 20 then 'pathways' when p_size <= 45 then 'reactions' else 'genes' end as kind,
        case when p_size > 25 then concat('P', cast(p_partkey % 150 as {S})) end as pathway from {part}""",
    "nodes": """select concat('R', cast(r_regionkey as {S})) as node, cast(r_regionkey as bigint) as db_id, 'TopLevelPathway' as label, r_name as name from {region}
        union all select concat('N', cast(n_nationkey as {S})), cast(n_nationkey as bigint), 'Pathway', n_name from {nation}
        union all select concat('P', cast(c_custkey as {S})), c_custkey, 'Pathway', concat(c_mktsegment, ' ', cast(c_nationkey as {S})) from {customer}
        union all select concat('X', cast(o_orderkey as {S})), o_orderkey, 'ReactionLikeEvent', concat('Reaction ', cast(o_orderkey as {S})) from {orders}
        union all select concat('E', cast(p_partkey as {S})), p_partkey, 'EntityWithAccessionedSequence', p_name from {part}""",
    "node_texts": "select concat('P', cast(doc_id as {S})) as node, text from {documents}",
    "graph_requests": """select p.p_partkey as id, concat('E', cast(p.p_partkey as {S})) as gene,
        case when p.p_size <= 20 then 'pathways' when p.p_size <= 45 then 'reactions' else 'genes' end as kind,
        case when p.p_size > 25 then concat('P', cast(m.pw as {S})) end as pathway
        from {part} p left join (select gene, min(pathway_id) as pw from {membership} group by gene) m on m.gene = p.p_partkey""",
    "searches": "select item_id as id, split_part(text, ' ', 1) as gene, split_part(text, ' ', 2) as more from {benchmark}",
    "boolean_searches": """select item_id as id, split_part(text, ' ', 1) as a, split_part(text, ' ', 2) as b, split_part(text, ' ', 5) as c, concat(split_part(text, ' ', 3), ' ', split_part(text, ' ', 4)) as d,
        concat('(', split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), ' OR ', split_part(text, ' ', 5), ') AND "', split_part(text, ' ', 3), ' ', split_part(text, ' ', 4), '"') as term from {benchmark}""",
    "results": """select s_name as gene, s_nationkey % 3 <> 1 as ok, case when s_nationkey < 20 then cast(s_nationkey as double) / 32 end as quality, s_suppkey as instances, cast(s_nationkey as bigint) as evidence from {supplier}""",
    "dated_abstracts": "select cast(d.doc_id as {S}) as pmid, d.text as abstract, cast(o.o_orderdate as date) as published, d.source as journal from {documents} d left join {orders} o on o.o_orderkey = d.doc_id",
    "pathway_vectors": "select vec_id as pathway, embedding from {embeddings}",
    "paper_vectors": "select cast(cast(floor(vec_id / 5) as bigint) as {S}) as pmid, vec_id % 5 as start, embedding from {embeddings}",
    "literature": "select doc_id as query_gene, cast(doc_id as {S}) as pmid from {labels}",
    "batches": """select s_suppkey as batch_id, concat('{{"entities":[{{"class":"Entity","displayName":"', s_name, '"}}', case when s_acctbal < 0 then ',{{"displayName":"second"}}' else '' end,
        ',{{', case when s_nationkey < 12 then '"class":"Complex"' else '"note":null' end, '}}],"reactions":[', case when s_acctbal > 5000 then '{{"class":"Reaction"}},{{"displayName":null}}' else '' end, ']',
        case when s_nationkey < 20 then ',"pathways":[{{"displayName":"a"}},{{}}]' else '' end, ',"papers":["1","2"]}}') as doc from {supplier}""",
    "vote_rows": """select d.source as gene, l.doc_id as voter, case when l.toxic = 1 and l.quality = 0 then 'reject' when l.toxic = 1 or l.quality = 0 then 'requires_revision' else 'approve' end as decision,
        cast((l.doc_id * 37) % 100 as double) / 100 as confidence, d.lang from {labels} l join {documents} d on d.doc_id = l.doc_id""",
    "answers": """select event_id as id, case event_type when 'click' then props when 'view' then concat('[', props, ',7]') when 'purchase' then cast(event_id as {S}) when 'signup' then 'plain words'
        else concat('{{"confidence":0.25,"decision":"reject","required_revisions":["r', cast(user_id as {S}), '"]}}') end as said from {events}""",
    "job_events": """select user_id as job_id, event_id, ts,
        case when event_type in ('click','view') then 'tool' when event_type = 'purchase' then 'agent' else 'job' end as event_type,
        case event_type when 'error' then 'error' when 'purchase' then 'end' when 'signup' then 'start' else 'running' end as status from {events}""",
    "votes": """select doc_id % 20 as gene, doc_id as voter,
        case when toxic = 1 and quality = 0 then 'reject' when toxic = 1 or quality = 0 then 'requires_revision' else 'approve' end as decision,
        cast((doc_id * 37) % 100 as double) / 100 as confidence from {labels}""",
    "instances": """select s_suppkey as batch_id, concat('{{"entities":[{{', case when s_suppkey % 3 = 0 then '' else '"class":"Entity",' end,
        case when s_suppkey % 5 = 0 then '"note":null' else concat('"displayName":"', s_name, '"') end,
        '}}],"reactions":[],"pathways":[{{"displayName":"', s_name, '"}}]}}') as doc from {supplier}""",
}


def _met(lineitem: DataFrame, flag: str) -> DataFrame:
    """gene_a, gene_b, pmid: the rows of the view of interactions that leaves this flag out.

    Lines are dealt to their orders once, in as many tasks as there are shuffle partitions, since pairs take far more room
    than what is dealt. A part counts once in an order and meets those behind it, so no pair is formed twice.
    """
    lines = lineitem.where(F.col("l_returnflag") != flag).select(F.col("l_partkey").alias("gene_a"), F.col("l_orderkey").alias("pmid")).dropna()
    of_order = Window.partitionBy("pmid").orderBy("gene_a")
    all_of_order = of_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = lines.repartition(parts(lineitem), "pmid").select("gene_a", "pmid", F.lag("gene_a").over(of_order).alias("before"), F.collect_set("gene_a").over(all_of_order).alias("genes"))
    behind = F.explode(F.filter("genes", lambda g: g > F.col("gene_a")))
    return seen.where("before is null or before <> gene_a").select("gene_a", behind.alias("gene_b"), "pmid")


#: Views that Spark makes in another way than their SQL says, with the same rows.
MADE = {"ppi_intact": lambda i: _met(i.lineitem, "R"), "ppi_biogrid": lambda i: _met(i.lineitem, "A")}


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)) if n != "S"]


class Inputs:
    """Base tables and stand-in views of one data folder; views are built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, written: dict[str, DataFrame] | None = None):
        """written gives views that have been made before."""
        self.spark, self.sf_dir, self._made = spark, sf_dir, dict(written or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in MADE:
                self._made[name] = MADE[name](self)
            else:
                sql = VIEWS[name]
                self._made[name] = self.spark.sql(sql.replace("{S}", "string"), **{n: getattr(self, n) for n in _needs(sql)})
        return self._made[name]


def oracle(sql: str, recursive: bool = False) -> str:
    """sql with the CTEs of the views it names as {view}."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _needs(VIEWS[name]):
                visit(n)
            order.append(name)

    for n in _needs(sql):
        visit(n)

    def plain(text: str) -> str:
        text = text.replace("{S}", "varchar")
        for n in _needs(text):
            text = text.replace("{" + n + "}", n)
        return text.replace("{{", "{").replace("}}", "}")

    ctes = ",\n".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if body.lower().startswith("with "):
        body = body[5:].strip()
        return f"with {'recursive ' if recursive else ''}{ctes}{', ' if ctes else ''}{body}"
    return (f"with {'recursive ' if recursive else ''}{ctes}\n" if ctes else "") + body
