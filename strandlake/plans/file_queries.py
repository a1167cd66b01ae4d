"""Registered queries that go through files: each writes what it derives from the tables, reads it back and works on that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import network
from strandlake.plans.catalog import _PARSED
from strandlake.plans.fixtures import Inputs
from strandlake.plans.registry import query
from strandlake.session import shared_path
from strandlake.sources import articles, files, matrix

# --- articles ------------------------------------------------------------------------------------------------------


def _element(name: str, text, attributes: str = "") -> F.Column:
    """An XML element, or nothing where its text is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), articles.escaped(text.cast("string")), F.lit(f"</{name}>")), F.lit(""))


def _article_files(i: Inputs) -> DataFrame:
    """Every document as an article, with a title that is not closed in one of 50, in as many files as Spark writes."""
    text = F.trim(F.regexp_replace(F.coalesce("abstract", F.lit("")), "[\\x00-\\x20\\x7f]+", " "))
    rows = i.dated_abstracts.withColumn("t", text)
    whole = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = F.col("pmid").cast("long")
    record = whole(
        "<PubmedArticle>\n<MedlineCitation>", _element("PMID", F.col("pmid")), "<Article><Journal><JournalIssue><PubDate>", F.when(number % 2 == 0, _element("Year", F.year("published"))).otherwise(_element("MedlineDate", F.concat(F.lit("Spring "), F.year("published").cast("string")))),
        "</PubDate></JournalIssue>", _element("Title", F.col("journal")), "</Journal><ArticleTitle>On <i>", articles.escaped(F.col("pmid")), "</i> &amp; more", F.when(number % 50 == 7, "").otherwise("</ArticleTitle>"),
        "<Abstract>", _element("AbstractText", F.substring("t", 1, 60), ' Label="START"'), _element("AbstractText", F.expr("substring(t, 61)")), "</Abstract><AuthorList>",
        "<Author>", _element("LastName", F.col("journal")), _element("ForeName", F.when(number % 4 != 1, F.col("pmid"))), "</Author>", F.when(number % 3 == 0, whole("<Author>", _element("CollectiveName", F.concat(F.lit("Group "), "pmid")), "</Author>")).otherwise(""),
        "</AuthorList></Article></MedlineCitation></PubmedArticle>",
    )
    path = shared_path(i.spark, "articles")
    rows.select(record).write.text(path)
    return articles.article_files(i.spark, path)


_ARTICLES = r"""a as (select pmid, pmid::bigint as n, published, journal, trim(regexp_replace(coalesce(abstract, ''), '[\x00-\x20\x7f]+', ' ', 'g')) as t from {dated_abstracts})"""


@query(f"""with {_ARTICLES} select pmid, concat('On ', pmid, ' & more') as title, md5(concat('START: ', trim(substr(t, 1, 60)), chr(10), trim(substr(t, 61)))) as abstract_md5,
concat_ws('; ', nullif(concat_ws(', ', journal, case when n % 4 <> 1 then pmid end), ''), case when n % 3 = 0 then concat('Group ', pmid) end) as authors, coalesce(trim(journal), '') as journal, coalesce(year(published)::varchar, '') as year from a where n % 50 <> 7""")
def article_files(i: Inputs) -> DataFrame:
    """Articles read from XML files of many articles each."""
    return articles.articles(_article_files(i)).select("pmid", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "authors", "journal", "year")


@query("select cast(doc_id as varchar) as pmid from {documents} where doc_id % 50 = 7")
def article_failures(i: Inputs) -> DataFrame:
    """The records that could not be read, kept apart."""
    return articles.failures(_article_files(i)).select(F.regexp_extract("record", r"<PMID>(\d+)</PMID>", 1).alias("pmid"))


# --- interactions, pathways, genes, vectors ------------------------------------------------------------------------


def _tsv(df: DataFrame, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    df.write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return path


@query(f"""with {_PARSED}, u as (select * from oki union all select * from okb),
p as (select distinct least(ga, gb) as a, greatest(ga, gb) as b from u) select (select count(*) from p)::double as interactions, (select count(distinct pm) from u) as publications""")
def interaction_files(i: Inputs) -> DataFrame:
    """Both interaction files, tab-separated with their own headers, read and merged."""
    intact = i.intact_raw.select(F.col("alias_a").alias("Alias(es) interactor A"), F.col("alias_b").alias("Alias(es) interactor B"), F.col("pubs").alias("Publication Identifier(s)"))
    biogrid = i.biogrid_raw.select(F.col("symbol_a").alias("Official Symbol Interactor A"), F.col("symbol_b").alias("Official Symbol Interactor B"), F.col("source").alias("Publication Source"))
    read = network.intact_interactions(files.intact_file(i.spark, _tsv(intact, "intact"))), network.biogrid_interactions(files.biogrid_file(i.spark, _tsv(biogrid, "biogrid")))
    return network.totals(*read).select(F.col("interactions").cast("double"), "publications")


@query("select cast(gene_a as varchar) as gene, cast(gene_b as varchar) as partner, score from {fi} where score > 0.8")
def scored_network_file(i: Inputs) -> DataFrame:
    """Partners from saved score maps, one row a gene."""
    scored = i.fi.select(F.col("gene_a").cast("string"), F.col("gene_b").cast("string"), "score")
    index = i.part.select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_partkey").cast("int").alias("idx"))
    path = shared_path(i.spark, "scored")
    network.network_documents(scored, index).write.parquet(path)
    return network.network_partners(files.scored_network_table(i.spark, path), index)


@query("select row_number() over (order by c.c_custkey) - 1 as ord, concat('Pathway ', c.c_custkey::varchar) as pathway, n.n_name as top_level from {customer} c join {nation} n on n.n_nationkey = c.c_nationkey where n.n_name <> 'FRANCE'")
def hierarchy_from_file(i: Inputs) -> DataFrame:
    """The lines of a hierarchy file without one top level, numbered in the order of the file."""
    rows = i.customer.join(F.broadcast(i.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    lines = rows.orderBy("c_custkey").select(F.concat(F.lit("Pathway "), F.col("c_custkey").cast("string")).alias("Pathway"), F.col("n_name").alias("Top_Level_Pathway"))
    return files.hierarchy_file(i.spark, _tsv(lines, "hierarchy"), "FRANCE")


@query("select gene, count(*) as n from (select concat('G', l_partkey::varchar) as gene from {lineitem}) group by gene")
def gene_list_from_file(i: Inputs) -> DataFrame:
    """A list of genes, one a line between blanks, with how often each is listed."""
    path = shared_path(i.spark, "genes")
    i.lineitem.select(F.concat(F.lit(" G"), F.col("l_partkey").cast("string"), F.lit("\t "))).write.text(path)
    return files.gene_list_file(i.spark, path).groupBy("gene").agg(F.count("*").alias("n"))


@query("select vec_id as db_id, concat('v', label::varchar) as display_name, case when vec_id % 3 = 0 then '-1' else (vec_id % 5)::varchar end as start_index, len(embedding)::bigint as dims, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from {embeddings}")
def vector_index_file(i: Inputs) -> DataFrame:
    """A saved vector index, read back; an unknown start is '-1'."""
    path = shared_path(i.spark, "vectors")
    start = F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 5)
    files.save_vector_index(i.embeddings.select(F.col("vec_id").alias("db_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("display_name"), start.alias("start_index"), "embedding"), path)
    read = files.vector_index(i.spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read.select("db_id", "display_name", "start_index", F.size("embedding").cast("long").alias("dims"), F.round(total, 6).alias("total"))


@query("""select 'json' as kind, gene, ok::varchar as ok, quality, instances from {results} union all select 'csv', gene, ok::varchar, quality, instances from {results}
union all select 'batch', gene, 'true', coalesce(quality, 0.0), instances from {results} where ok union all select 'total', count(*)::varchar, (count(*) filter (where ok))::varchar, null, null from {results}
union all select 'text', gene, null, null, null from {results} union all select 'text', gene, null, null, null from {results} where ok""")
def result_files(i: Inputs) -> DataFrame:
    """Results as JSON, CSV, batch summary and appended text, all read back."""
    spark, path = i.spark, shared_path(i.spark, "results")
    kind = "gene string, ok boolean, quality double, instances long, evidence long"
    files.export_json(i.results, f"{path}/json")
    files.export_csv(i.results, f"{path}/csv")
    files.export_batch(i.results, f"{path}/batch")
    files.append_text(i.results.select("gene"), f"{path}/text")
    files.append_text(i.results.where("ok").select("gene"), f"{path}/text")
    none = lambda t: F.lit(None).cast(t)
    plain = lambda df, name: df.select(F.lit(name).alias("kind"), "gene", F.col("ok").cast("string").alias("ok"), "quality", "instances")
    each = spark.read.schema("gene string, quality_score double, instances_created long, evidence_count long").json(f"{path}/batch/results")
    total = spark.read.schema("total_genes long, successful long").json(f"{path}/batch/summary")
    out = plain(spark.read.schema(kind).json(f"{path}/json"), "json").unionByName(plain(spark.read.schema(kind).csv(f"{path}/csv", header=True), "csv"))
    out = out.unionByName(each.select(F.lit("batch").alias("kind"), "gene", F.lit("true").alias("ok"), F.col("quality_score").alias("quality"), F.col("instances_created").alias("instances")))
    out = out.unionByName(total.select(F.lit("total").alias("kind"), F.col("total_genes").cast("string").alias("gene"), F.col("successful").cast("string").alias("ok"), none("double").alias("quality"), none("long").alias("instances")))
    return out.unionByName(spark.read.text(f"{path}/text").select(F.lit("text").alias("kind"), F.col("value").alias("gene"), none("string").alias("ok"), none("double").alias("quality"), none("long").alias("instances")))


@query("""with v as (select vec_id % 97 as db_id, concat('v', label::varchar) as display_name, case when vec_id % 3 = 0 then '-1' else (vec_id // 97)::varchar end as start_index, embedding from {embeddings})
select row_number() over (order by db_id, start_index::bigint, display_name) - 1 as row, db_id, display_name, start_index, len(embedding)::bigint as dims from v""")
def matrix_file(i: Inputs) -> DataFrame:
    """Vectors as a dense matrix with the owner of every row, read back."""
    path = shared_path(i.spark, "matrix")
    start = F.when(F.col("vec_id") % 3 != 0, F.expr("vec_id div 97"))
    matrix.save_matrix(i.embeddings.select((F.col("vec_id") % 97).alias("db_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("display_name"), start.alias("start_index"), "embedding"), path, 64)
    return matrix.matrix_rows(i.spark, path).select("row", "db_id", "display_name", "start_index", F.size("vector").cast("long").alias("dims"))
