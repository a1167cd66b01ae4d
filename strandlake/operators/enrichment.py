"""Gene-set enrichment for any number of query genes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import stats


def gene_sets(rows: DataFrame, genes: str = "genes") -> DataFrame:
    """pathway_id, gene from comma-joined lists; repeats inside a list stay."""
    return rows.select("pathway_id", F.explode(F.split(F.col(genes), ",")).alias("gene"))


def sizes(membership: DataFrame) -> DataFrame:
    """Raw length and distinct length of each set."""
    return membership.groupBy("pathway_id").agg(F.count("*").alias("n_listed"), F.count_distinct("gene").alias("n_genes"))


def _met(partners: DataFrame, membership: DataFrame, *carried: Column) -> DataFrame:
    """query_gene, pathway_id and carried columns of each partner in a pathway, with the rows of a gene in one partition.

    A partner travels once to its query gene, with the list of its pathways, and not once for each of them.
    """
    of_gene = membership.select("pathway_id", F.col("gene").alias("partner")).distinct().groupBy("partner").agg(F.collect_list("pathway_id").alias("_ids"))
    rows = partners.join(of_gene, "partner").select("query_gene", "_ids", *carried)
    # Lists grow where they are unrolled: partitions that look small enough to be coalesced before are not small after.
    rows = rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_gene")
    names = [c for c in rows.columns if c not in ("query_gene", "_ids")]
    return rows.select("query_gene", F.explode("_ids").alias("pathway_id"), *names)


def hits(partners: DataFrame, membership: DataFrame) -> DataFrame:
    """Per query gene and pathway the partners in it with their publications, and their number."""
    met = _met(partners, membership, F.struct("partner", "pmids").alias("_mapped"))
    return met.groupBy("query_gene", "pathway_id").agg(F.count("*").alias("overlap_count"), F.array_sort(F.collect_list("_mapped")).alias("mapped"))


def hit_counts(partners: DataFrame, membership: DataFrame) -> DataFrame:
    """Per query gene and pathway the number of partners in it and that of their publications; no list is gathered."""
    met = _met(partners, membership, F.size("pmids").cast("long").alias("_n"))
    return met.groupBy("query_gene", "pathway_id").agg(F.count("*").alias("overlap_count"), F.sum("_n").alias("n_publications"))


#: Set memberships that a task counts at a time, and the room that rounding of a false-discovery rate may need.
_AT_ONCE, _ROUNDED = 1 << 20, 1e-9


def _whole_genes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that never part a gene; those of a gene with more than fit one are folded to counts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(pa.compute.list_flatten(batch["ids"]))
        if size < _AT_ONCE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        codes = table["query_gene"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        last = int(np.argmax(codes == codes[-1]))
        if last:
            yield table.slice(0, last)
        rest = table.slice(last) if last else _folded(table)
        held, size = rest.to_batches(), len(rest["ids"].combine_chunks().flatten()) if last else 0
    if held:
        yield pa.Table.from_batches(held)


def _folded(table: pa.Table) -> pa.Table:
    """The rows of one gene as two: what its partners hit, each pathway once with a count, and what it is annotated to."""
    out = []
    for own in (False, True):
        rows = table.filter(pa.compute.equal(table["own"], own))
        if len(rows):
            _, pathway, size, hits, ids = _counted(rows)
            total = pa.compute.sum(rows["n"]).as_py()
            out.append([rows["query_gene"][:1].combine_chunks(), pa.array([own]), pa.array([total], pa.int64()), *[pa.array([x], table.schema.field(c).type) for c, x in (("ids", ids(pathway).to_pylist()), ("sizes", size), ("hits", hits))], rows["background"][:1].combine_chunks()])
    return pa.concat_tables([pa.Table.from_arrays(x, schema=table.schema) for x in out]).combine_chunks()


def _counted(rows: pa.Table) -> tuple:
    """gene (a number), pathway (a number, in the order of the ids), size and hits of all pairs, and the ids of numbers."""
    ids, sizes, hits = (rows[c].combine_chunks() for c in ("ids", "sizes", "hits"))
    lengths, gene = pa.compute.list_value_length(ids).to_numpy(), rows["gene"].to_numpy() if "gene" in rows.column_names else np.zeros(len(rows), np.int64)
    gene, size, flat = np.repeat(gene, lengths), sizes.flatten().to_numpy(), ids.flatten()
    top, wide, ints = int(size.max(initial=0)) + 1, int(gene.max(initial=0)) + 1, pa.types.is_integer(flat.type) and len(flat) and not flat.null_count
    low = int(pa.compute.min(flat).as_py()) if ints else 0
    span = int(pa.compute.max(flat).as_py()) - low + 1 if ints else 0
    if ints and wide * span * top < 1 << 62:
        number, name = flat.to_numpy().astype(np.int64) - low, lambda x: pa.array(x + low, flat.type)
    else:
        coded = flat.dictionary_encode("encode")
        order = pa.compute.sort_indices(coded.dictionary, null_placement="at_start")
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        number, span, names = place[coded.indices.to_numpy()], len(order), coded.dictionary.take(order)
        name = lambda x: names.take(pa.array(x))
    key = (gene * span + number) * top + size
    if hits.null_count == len(hits):
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n, key = np.diff(np.r_[first, len(key)]), key[first]
    else:
        one = [np.ones(k, np.int64) if h is None else np.asarray(h) for h, k in zip(hits.to_pylist(), lengths, strict=True)]
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, np.concatenate(one), len(key)).astype(np.int64)
    pair, size = np.divmod(key, top)
    gene, number = np.divmod(pair, max(span, 1))
    return gene, number, size, n, name


def _tails(k: np.ndarray, n: np.ndarray, size: np.ndarray, background: int) -> np.ndarray:
    """The tail of each (overlap, tests, size); equal ones are tested once."""
    a, b, c = (int(x.max()) + 1 for x in (k, n, size))
    key = (k * b + n) * c + size
    if a * b * c <= 1 << 22:
        seen = np.zeros(a * b * c, bool)
        seen[key] = True
        once, table = np.flatnonzero(seen), np.zeros(a * b * c)
        at = key
    else:
        once, at = np.unique(key, return_inverse=True)
        table = np.zeros(len(once))
    rest, s = np.divmod(once, c)
    x, t = np.divmod(rest, b)
    table[once if a * b * c <= 1 << 22 else slice(None)] = stats.binomial_tails(x, t, np.minimum(s / background, 1.0))
    return table[at]


def _tested(rows: pa.Table, fdr: float | None, best: int | None) -> list[pa.Array]:
    """query_gene, n_test, pathway_id, size, overlap_count, background, p_value and fdr of whole genes."""
    coded = rows["query_gene"].combine_chunks().dictionary_encode("encode")
    code, own = coded.indices.to_numpy(), rows["own"].to_numpy()
    rows = rows.append_column("gene", pa.array(code.astype(np.int64)))
    n_test = np.bincount(code, rows["n"].to_numpy() * ~own, int(code.max()) + 1).astype(np.int64)
    gene, number, size, hits, name = _counted(rows.filter(pa.array(~own)))
    background = rows["background"][0].as_py()
    p = _tails(hits, n_test[gene], size, background) if len(gene) else np.zeros(0)
    q, keep = np.empty(len(p)), np.zeros(len(p), bool)
    ends = np.flatnonzero(np.r_[gene[1:] != gene[:-1], True]) + 1 if len(gene) else []
    ids = name(number)
    barred = _annotated(rows.filter(pa.array(own)), gene, ids) if own.any() else np.zeros(len(p), bool)
    for a, b in zip(np.r_[0, ends[:-1]] if len(gene) else [], ends, strict=True):
        order = np.argsort(p[a:b], kind="stable")
        upward = (p[a:b][order] * (b - a) / np.arange(1, b - a + 1))[::-1]
        q[a:b][order] = np.minimum(1.0, np.minimum.accumulate(upward)[::-1])
        fine = np.flatnonzero(~barred[a:b] & (q[a:b] < fdr if fdr is not None else True))
        if best is not None and len(fine) > best:
            # Rows come by id: of each rate near enough to be among the best after rounding the first ones.
            fine = fine[np.argsort(q[a:b][fine], kind="stable")]
            rate = q[a:b][fine]
            fine, rate = fine[rate <= rate[best - 1] + _ROUNDED], rate[rate <= rate[best - 1] + _ROUNDED]
            fine = fine[np.arange(len(fine)) - np.searchsorted(rate, rate, "left") < best]
        keep[a + fine] = True
    at = np.flatnonzero(keep)
    gene = gene[at]
    return [coded.dictionary.take(pa.array(gene)), pa.array(n_test[gene]), ids.take(pa.array(at)), pa.array(size[at]), pa.array(hits[at]), pa.array(np.full(len(at), background)), pa.array(p[at]), pa.array(q[at])]


def _annotated(own: pa.Table, gene: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Whether each (gene, id) is one of own (gene, ids)."""
    lists = own["ids"].combine_chunks()
    mine, flat = np.repeat(own["gene"].to_numpy(), pa.compute.list_value_length(lists).to_numpy()), lists.flatten()
    code = pa.concat_arrays([ids, flat]).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    wide = int(code.max(initial=0)) + 1
    return np.isin(gene * wide + code[: len(ids)], mine * wide + code[len(ids) :])


def partner_enrichment(partners: DataFrame, membership: DataFrame, fdr: float | None = 0.05, best: int | None = None, annotated: DataFrame | None = None) -> DataFrame:
    """Over-representation of each query gene's partners, with strict fdr cutoff.

    Partners (query_gene, partner) are distinct. Those outside all sets don't count; a set's size is its listed length; the
    correction covers the pathways with at least one hit. A query gene without hits has no row. annotated (query_gene,
    pathway_id) drops these rows after the correction. best keeps of each gene the rows that may be among the first so
    many by fdr, rounded to nine digits or more, and id: top() gives exactly these.

    A partner travels once to each of its query genes, with its sets as lists; the pairs of genes and pathways are counted,
    tested, corrected and dropped where the gene's partners meet, and never travel.
    """
    here = Window.partitionBy("pathway_id")
    listed = membership.select("pathway_id", F.col("gene").alias("partner")).repartition("pathway_id").groupBy("pathway_id", "partner").agg(F.count("*").alias("n"))
    of_gene = listed.withColumn("size", F.sum("n").over(here)).groupBy("partner").agg(F.collect_list(F.struct("pathway_id", "size")).alias("sets"))  # one row a gene
    none, one = F.lit(None).cast("array<bigint>").alias("hits"), F.lit(1).cast("long").alias("n")
    rows = partners.select("query_gene", "partner").join(of_gene.select("partner", F.col("sets.pathway_id").alias("ids"), F.col("sets.size").alias("sizes")), "partner")
    rows = rows.select("query_gene", F.lit(False).alias("own"), one, "ids", "sizes", none)
    if annotated is not None:
        own = annotated.groupBy("query_gene").agg(F.collect_set("pathway_id").alias("ids"))
        rows = rows.unionByName(own.select("query_gene", F.lit(True).alias("own"), one, "ids", F.transform("ids", lambda x: F.lit(0).cast("long")).alias("sizes"), none))
    background = membership.agg(F.count_distinct("gene").alias("background"))
    rows = rows.crossJoin(F.broadcast(background)).repartition("query_gene").sortWithinPartitions("query_gene")  # one row
    gene, pathway = (df.schema[c].dataType.simpleString() for df, c in ((partners, "query_gene"), (membership, "pathway_id")))
    schema = f"query_gene {gene}, n_test long, pathway_id {pathway}, size long, overlap_count long, background long, p_value double, fdr double"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_genes(batches):
            yield pa.RecordBatch.from_arrays(_tested(table, fdr, best), names=names)

    return rows.mapInArrow(tested, schema)


def list_enrichment(genes: DataFrame, membership: DataFrame) -> DataFrame:
    """Over-representation of gene lists (query_gene, gene) as sets: unmapped genes count, and there is no cutoff."""
    lists, sets = genes.select("query_gene", "gene").distinct(), membership.select("pathway_id", "gene").distinct()
    lists = lists.withColumn("n_test", F.count("*").over(Window.partitionBy("query_gene")))
    sets = sets.withColumn("size", F.count("*").over(Window.partitionBy("pathway_id")))
    overlaps = lists.join(sets, "gene").groupBy("query_gene", "n_test", "pathway_id", "size").agg(F.count("*").alias("overlap_count"))
    background = membership.agg(F.count_distinct("gene").alias("background"))
    p = stats.with_tails(overlaps.crossJoin(F.broadcast(background)), "overlap_count", "n_test", "size", "background")  # one row
    return stats.benjamini_hochberg(p, "p_value", ["query_gene"])


def top(enriched: DataFrame, n: int = 8) -> DataFrame:
    """The n pathways of least fdr per query gene; ties by id."""
    order = Window.partitionBy("query_gene").orderBy("fdr", "pathway_id")
    return enriched.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def first_per_pathway(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each (query gene, pathway) in this order."""
    nth = F.row_number().over(Window.partitionBy("query_gene", "pathway").orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def without_annotated(enriched: DataFrame, annotated: DataFrame) -> DataFrame:
    """Drop pathways that already list the query gene; annotated has query_gene, pathway_id."""
    return enriched.join(annotated, ["query_gene", "pathway_id"], "left_anti")


def cutoff_sweep(scored_partners: DataFrame, membership: DataFrame, cutoffs=("0.9", "0.8", "0.7", "0.6", "0.5"), least: int = 10, fdr: float = 0.05) -> DataFrame:
    """Per query gene the first (highest) cutoff that gives at least `least` pathways, else the lowest, and its count.

    All cutoffs run as one enrichment with (gene, cutoff) as the query key.
    """
    steps = F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff")
    runs = scored_partners.select("query_gene", "partner", "score", steps).where(F.col("score") > F.col("cutoff").cast("double"))
    keyed = runs.select(F.to_json(F.struct("query_gene", "cutoff")).alias("query_gene"), "partner").distinct()
    found = partner_enrichment(keyed, membership, fdr).groupBy("query_gene").agg(F.count("*").alias("n_pathways"))
    asked = scored_partners.select("query_gene").distinct().select("query_gene", steps)
    kind = f"query_gene {scored_partners.schema['query_gene'].dataType.simpleString()}, cutoff string"
    found = found.select(F.from_json("query_gene", kind).alias("k"), "n_pathways").select("k.*", "n_pathways")
    counts = asked.join(found, ["query_gene", "cutoff"], "left").withColumn("n_pathways", F.coalesce("n_pathways", F.lit(0)))
    enough = F.max(F.when(F.col("n_pathways") >= least, F.col("cutoff").cast("decimal(2,1)")))
    chosen = counts.groupBy("query_gene").agg(F.coalesce(enough, F.min(F.col("cutoff").cast("decimal(2,1)"))).alias("chosen"))
    return counts.join(chosen, "query_gene").where(F.col("cutoff").cast("decimal(2,1)") == F.col("chosen")).select("query_gene", "cutoff", "n_pathways")
