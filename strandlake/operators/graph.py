"""Closures and lookups over a property graph of nodes and typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import parsing
from strandlake.session import kept

PARTICIPATION = ("input", "catalystActivity", "regulatedBy", "physicalEntity", "hasComponent", "hasMember", "hasCandidate")


def closure(start: DataFrame, edges: DataFrame, carried: tuple[str, ...] = ("root",)) -> DataFrame:
    """All states (carried..., node) reachable over edges (src, dst) from the states of start.

    Breadth first; states seen before never enter the frontier again, so cycles end. Each round is
    written to the shared folder, so lost executors cost one round.
    """
    state = [*carried, "node"]
    seen = frontier = kept(start.select(*state).distinct())
    steps = edges.select("src", "dst")
    while True:
        reached = frontier.join(steps, frontier["node"] == steps["src"]).select(*carried, F.col("dst").alias("node")).distinct()
        frontier = kept(reached.join(seen, state, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)  # a union of written rounds: nothing is written twice


def descendants(roots: DataFrame, edges: DataFrame, rel: str = "hasEvent") -> DataFrame:
    """root, node of every node one or more rel steps below a root (roots has column root)."""
    steps = edges.where(F.col("rel") == rel)
    first = roots.join(steps, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"))
    return closure(first, steps)


def participation(edges: DataFrame, reactions: DataFrame) -> DataFrame:
    """reaction, role, node over one or more participation steps; the role is that of the first step.

    The closure runs over the entities that are first steps, each once, whatever number of reactions starts there, and over
    the steps between entities only. A first step travels to its reaction once, with the list of what is below its entity.
    """
    steps = edges.where(F.col("rel").isin(*PARTICIPATION))
    entities = steps.select(F.col("dst").alias("src")).distinct()
    inner = kept(steps.join(entities, "src", "left_semi").select("src", "dst").distinct())
    first = steps.join(reactions, F.col("src") == F.col("reaction")).select("reaction", parsing.role_name("rel").alias("role"), F.col("dst").alias("entity"))
    first = kept(first.distinct())
    below = closure(first.select("entity", F.col("entity").alias("node")), inner, ("entity",))
    lists = below.groupBy("entity").agg(F.collect_list("node").alias("nodes"))
    there = first.join(lists, "entity").select("reaction", "role", "nodes").repartition("reaction")
    return there.select("reaction", "role", F.explode("nodes").alias("node")).distinct()


def reaction_roles(edges: DataFrame, pathways: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """pathway, reaction, role, gene of the reactions below each pathway; genes (column gene) restricts them.

    Rows are distinct, since (pathway, reaction) and (reaction, role, gene) are.
    """
    below = descendants(pathways.withColumnRenamed("pathway", "root"), edges).select(F.col("root").alias("pathway"), F.col("node").alias("reaction"))
    roles = participation(edges, below.select("reaction").distinct())
    if genes is not None:
        roles = roles.join(genes.withColumnRenamed("gene", "node"), "node", "left_semi")
    return below.join(roles, "reaction").select("pathway", "reaction", "role", F.col("node").alias("gene"))


def topic_pick(topics: DataFrame, events: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """event, topic: the first topic by name that is not excluded, else 'unknown'."""
    kept = topics.where(~F.col("topic").isin(*excluded)).groupBy("event").agg(F.min("topic").alias("topic"))
    return events.join(kept, "event", "left").select("event", F.coalesce("topic", F.lit("unknown")).alias("topic"))


def summaries(events: DataFrame, texts: DataFrame, limit: int | None = None) -> DataFrame:
    """db_id, name, summary of every event; an event without text keeps a null summary."""
    out = events.join(texts, "db_id", "left").select("db_id", "name", "summary")
    return out if limit is None else out.orderBy("db_id").limit(limit)


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    """node, db_id, name of the nodes of one label."""
    return nodes.where(F.col("label") == label).select("node", "db_id", "name")


def summary_of_name(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """name, db_id, text: of nodes that share a name the one with the smallest id, with its text or null."""
    found = nodes.join(texts, "node", "left").groupBy("name").agg(F.min_by(F.struct("db_id", "text"), F.struct("db_id", "node")).alias("x"))
    return found.select("name", "x.db_id", "x.text")


def pathways_of_genes(roles: DataFrame, nodes: DataFrame) -> DataFrame:
    """gene and the distinct names, in order, of the pathways it has a role in."""
    named = roles.select("gene", F.col("pathway").alias("node")).distinct().join(nodes.select("node", "name"), "node")
    return named.groupBy("gene").agg(F.array_sort(F.collect_set("name")).alias("names"))


def bottom_level(nodes: DataFrame, edges: DataFrame, label: str = "Pathway") -> DataFrame:
    """nodes of one label with bottom: whether no event of that label lies right below."""
    inner = nodes.where(F.col("label") == label)
    children = inner.select(F.col("node").alias("dst"))
    above = edges.where("rel = 'hasEvent'").join(children, "dst", "left_semi").select(F.col("src").alias("node"), F.lit(False).alias("bottom")).distinct()
    return inner.join(above, "node", "left").withColumn("bottom", F.coalesce("bottom", F.lit(True)))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """value, n and rank by n of the values of a column but null; ties by value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "value")).cast("long"))


def with_counts(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """tree (pathway, ...) with n of counts (pathway, n), 0 where there is none."""
    return tree.join(counts, "pathway", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def from_the_end(rows: DataFrame, ord: str = "ord") -> DataFrame:
    """rows with position: 0 for the largest ord, counting up to the smallest; ord is dense, as file sources number lines."""
    last = rows.agg(F.max(ord).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("position", F.col("_last") - F.col(ord)).drop("_last")  # one row


def numbered(rows: DataFrame, *order: str, ord: str = "ord") -> DataFrame:
    """rows with ord: 0, 1, 2 ... in this order.

    Rows are dealt to ranges of the order and written; a row's number is its place in its range and what the ranges
    before it hold, so no task has more than a range.
    """
    run, n, start, inside = (f"_{name}" + "_" * max(map(len, rows.columns)) for name in ("run", "n", "start", "inside"))  # longer than any name of rows
    ranged = kept(rows.repartitionByRange(*order).withColumn(run, F.spark_partition_id()))
    earlier = Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(run).agg(F.count("*").alias(n)).select(run, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(start))  # a row for each range
    placed = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1).join(starts, run)
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(start) + F.col(inside)).cast("long").alias(ord))


def merged(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Two key-value tables as one; where both have a key the right one's value counts."""
    r = right.select(key, F.col(value).alias("_right"), F.lit(True).alias("_has"))
    return left.join(r, key, "full_outer").select(key, F.when(F.col("_has"), F.col("_right")).otherwise(F.col(value)).alias(value))


def name_to_id(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name, db_id: of nodes that share a name the largest id."""
    return nodes.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.max("db_id").alias("db_id"))


def role_text(roles: DataFrame, *keys: str) -> DataFrame:
    """Per pathway (or keys) the distinct genes and the sorted role clauses; pathways without roles have no row."""
    clause = F.concat(F.col("gene"), F.lit(' in "'), F.col("reaction"), F.lit('" as '), F.col("role"))
    return roles.groupBy(*(keys or ("pathway",))).agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"), F.array_join(F.array_sort(F.collect_list(clause)), "; ").alias("role_text"))
