"""Interaction networks: tagged sources to undirected edges with their publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import parsing
from strandlake.session import parts


def _filled(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.length(F.col(n)) > 0)
    return out


def _complete(raw: DataFrame, gene_a: Column, gene_b: Column, pmid: Column) -> DataFrame:
    """gene_a, gene_b, pmid of the rows that have all three and two different genes.

    What is parsed is unrolled from a list of one: a filter right on it would parse anew for every condition.
    """
    parsed = F.struct(gene_a.alias("gene_a"), gene_b.alias("gene_b"), pmid.alias("pmid"))
    rows = raw.select(F.explode(F.array(parsed)).alias("_p")).select("_p.*")
    return rows.where(_filled("gene_a", "gene_b", "pmid") & (F.col("gene_a") != F.col("gene_b")))


def intact_interactions(raw: DataFrame, alias_a: str = "alias_a", alias_b: str = "alias_b", publications: str = "pubs") -> DataFrame:
    """gene_a, gene_b, pmid of complete rows between two different genes."""
    return _complete(raw, parsing.tagged_gene(alias_a), parsing.tagged_gene(alias_b), parsing.tagged_publication(publications))


def biogrid_interactions(raw: DataFrame, symbol_a: str = "symbol_a", symbol_b: str = "symbol_b", source: str = "source") -> DataFrame:
    return _complete(raw, F.col(symbol_a), F.col(symbol_b), parsing.prefixed_publication(source))


def both_ways(interactions: DataFrame) -> DataFrame:
    """gene, partner, pmid of each interaction seen from either end."""
    return _turned(interactions, F.col("gene_a"), F.col("gene_b"), "pmid")


def _turned(rows: DataFrame, a: Column, b: Column, *more: str) -> DataFrame:
    """gene, partner and more of each row, once as (a, b) and once as (b, a); rows is read once."""
    ends = F.array(F.struct(a.alias("gene"), b.alias("partner")), F.struct(b.alias("gene"), a.alias("partner")))
    return rows.select(F.explode(ends).alias("_e"), *more).select("_e.gene", "_e.partner", *more)


def _pairs(sources: tuple[DataFrame, ...]) -> DataFrame:
    """low, high, pmid: the interactions of all sources, the two genes of each in order (a missing one last)."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    ordered = (F.col("gene_a") <= F.col("gene_b")) | F.col("gene_b").isNull()
    low, high = F.when(ordered, F.col("gene_a")).otherwise(F.col("gene_b")), F.when(ordered, F.col("gene_b")).otherwise(F.col("gene_a"))
    return rows.select(low.alias("low"), high.alias("high"), "pmid")


def edges(*sources: DataFrame, only: Column | None = None) -> DataFrame:
    """gene, partner and the sorted distinct publications, over the union of all sources.

    only is a condition on gene. It stands below the aggregate because Spark moves no filter past a collected set.

    Without it a pair is dealt and collected once and then given from either end. Nothing is collected before it is dealt,
    as few rows of a task belong together there.
    """
    rows = _pairs(sources)
    if only is not None:
        flat = _turned(rows, F.col("low"), F.col("high"), "pmid").where(only)
        return flat.groupBy("gene", "partner").agg(F.array_sort(F.collect_set("pmid")).alias("pmids"))
    listed = rows.repartition(parts(rows), "low", "high").groupBy("low", "high").agg(F.array_sort(F.collect_set("pmid")).alias("pmids"))
    there, back = F.struct(F.col("low").alias("gene"), F.col("high").alias("partner")), F.struct(F.col("high").alias("gene"), F.col("low").alias("partner"))
    ends = F.when(F.col("low").eqNullSafe(F.col("high")), F.array(there)).otherwise(F.array(there, back))
    return listed.select(F.explode(ends).alias("_e"), "pmids").select("_e.gene", "_e.partner", "pmids")


def totals(*sources: DataFrame) -> DataFrame:
    """Interactions (pairs counted once, one of a gene with itself half) and distinct publications.

    The sources are read once: each interaction gives a row for its pair and one for its publication.
    """
    pair = F.struct(F.lit(True).alias("pair"), F.col("low").cast("string").alias("x"), F.col("high").cast("string").alias("y"))
    publication = F.struct(F.lit(False).alias("pair"), F.col("pmid").cast("string").alias("x"), F.lit(None).cast("string").alias("y"))
    seen = _pairs(sources).select(F.explode(F.array(pair, publication)).alias("_s")).select("_s.*").distinct()
    half = F.when(F.col("x").eqNullSafe(F.col("y")), 1).otherwise(2)
    return seen.agg((F.coalesce(F.sum(F.when(F.col("pair"), half)), F.lit(0)) / 2.0).alias("interactions"), F.count(F.when(~F.col("pair"), F.col("x"))).alias("publications"))


def supported_by(partners: DataFrame, scored: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """The edges whose ends the scored network joins with more than cutoff, either way round."""
    ends = scored.where(F.col("score") > cutoff)
    ends = ends.select(F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner")).unionByName(ends.select(F.col("gene_b").alias("gene"), F.col("gene_a").alias("partner")))
    return partners.join(ends.distinct(), ["gene", "partner"], "left_semi")


def network_documents(scored: DataFrame, index: DataFrame) -> DataFrame:
    """One row per gene with a map from partner index to score; of an edge that stands twice the larger score."""
    coded = scored.join(index, scored["gene_b"] == index["gene"]).where("idx >= 0").groupBy("gene_a", "idx").agg(F.max("score").alias("score"))
    return coded.groupBy(F.col("gene_a").alias("gene")).agg(F.map_from_entries(F.collect_list(F.struct("idx", "score"))).alias("combined_score"))


def network_partners(documents: DataFrame, index: DataFrame, cutoff: float | None = None) -> DataFrame:
    """gene, partner, score above the cutoff (0.8 if none is given) from score maps; unknown indexes go."""
    cutoff = 0.8 if cutoff is None else cutoff
    flat = documents.select("gene", F.explode("combined_score").alias("idx", "score")).where(F.col("score") > cutoff)
    return flat.join(index.select(F.col("gene").alias("partner"), "idx"), "idx").select("gene", "partner", "score")


def choose_source(name: str, interactions: DataFrame, scored: DataFrame, cutoff: float = 0.8, use_filter: bool = True) -> DataFrame:
    """gene, partner, pmids of the named source; scored partners, found from either end of an edge, have no publications."""
    if name == "intact_biogrid":
        return supported_by(interactions, scored, cutoff) if use_filter else interactions
    if name == "scored_network":
        near = scored.where(F.col("score") > cutoff)
        ends = near.select(F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner")).unionByName(near.select(F.col("gene_b").alias("gene"), F.col("gene_a").alias("partner")))
        return ends.distinct().withColumn("pmids", F.array().cast(interactions.schema["pmids"].dataType))
    raise ValueError(f"unknown interaction source: {name}")
