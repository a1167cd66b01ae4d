"""Deterministic scores and decision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import schemas


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))


def evidence(text: Column, reference: Column) -> Column:
    """overlap, score (0 to 10), strength, recommendation and confidence of an evidence text."""
    overlap = F.size(F.array_intersect(_tokens(text), _tokens(reference)))
    score = F.greatest(F.lit(0), F.least(F.lit(10), F.floor(overlap / 5).cast("int") + F.when(F.length(F.trim(text)) > 0, 4).otherwise(0)))
    return F.struct(
        overlap.cast("long").alias("overlap"), score.cast("long").alias("score"),
        F.when(score >= 7, "high").when(score >= 5, "medium").otherwise("low").alias("strength"),
        F.when(score >= 6, "accept").when(score >= 4, "review").otherwise("reject").alias("recommendation"),
        (score / 10.0).cast("double").alias("confidence"),
    )


def weighted(parts: dict[str, float]) -> Column:
    """The weighted sum of criterion columns, rounded to 6 places."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.col(name) * weight
    return F.round(total, 6)


REVIEW = {"accuracy": 0.25, "completeness": 0.25, "evidence": 0.25, "consistency": 0.25}
QA = {"compliance": 0.30, "integrity": 0.25, "citations": 0.25, "consistency": 0.20}


def review_decision(score: Column, critical: Column, major: Column, threshold: float = 0.7) -> Column:
    return F.when((score < 0.5) | major, "reject").when((score >= threshold) & ~critical, "approve").otherwise("revise")


def qa_decision(score: Column, high: Column, expert: Column, threshold: float = 0.7) -> Column:
    """expert is the reviewer's decision."""
    return F.when((score < 0.6) | high | (expert == "reject"), "reject").when((score >= threshold) & (expert == "approve"), "approve").otherwise("conditional")


def consensus(votes: DataFrame, sure: float = 0.7) -> DataFrame:
    """Tally, mean confidence and decision per gene: a sure rejection rejects, any wish for revision revises, else approve."""
    reject = (F.col("decision") == "reject") & (F.col("confidence") >= sure)
    tally = votes.groupBy("gene").agg(
        F.count("*").alias("n_votes"), F.count_if(F.col("decision") == "approve").alias("n_approve"), F.count_if(F.col("decision") == "requires_revision").alias("n_revision"),
        F.count_if(F.col("decision") == "reject").alias("n_reject"), F.round(F.avg("confidence"), 6).alias("confidence"), F.bool_or(reject).alias("_blocked"),
    )
    return tally.withColumn("decision", F.when(F.col("_blocked"), "reject").when(F.col("n_revision") > 0, "requires_revision").otherwise("approve")).drop("_blocked")


def consensus_report(votes: DataFrame, sure: float = 0.7) -> DataFrame:
    """consensus with the distinct required revisions and blocking issues of a gene's votes (arrays), sorted.

    Each text of a list is a row until it is distinct, so votes that say the same are never gathered.
    """
    kinds = ("required_revisions", "blocking_issues")
    tagged = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("kind"), x.alias("text")))
    said = F.flatten(F.array(*map(tagged, kinds)))
    each = votes.select("gene", F.explode(said).alias("x")).select("gene", "x.kind", "x.text").where(F.col("text").isNotNull()).distinct()
    lists = each.groupBy("gene").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == c, F.col("text")))).alias(c) for c in kinds])
    out = consensus(votes, sure).join(lists, "gene", "left")
    return out.select(*[c for c in out.columns if c not in kinds], *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in kinds])


def vote_decision(high: Column, issues: Column) -> Column:
    """A specialist's vote: any high-severity blocker rejects, none and no other issue approves, else revision."""
    return F.when(high > 0, "reject").when(issues == 0, "approve").otherwise("requires_revision")


def meets_threshold(quality: Column, threshold: float = 0.7) -> Column:
    """Whether an overall quality (0 where it is missing) reaches the threshold."""
    return F.coalesce(quality, F.lit(0.0)) >= threshold


def conflicts(new: DataFrame, existing: DataFrame, batch: str = "batch", name: str = "name") -> DataFrame:
    """Per batch its names that exist already, each new row counted, and the consistency score: 0.7 if any, else 1."""
    known = existing.select(name).distinct().withColumn("_known", F.lit(1))
    counts = new.join(known, name, "left").groupBy(batch).agg(F.count("_known").alias("conflicts"))
    return counts.withColumn("score", F.when(F.col("conflicts") > 0, 0.7).otherwise(1.0))


def validation_report(instances: DataFrame, schema: dict | None = None, key: str = "batch_id", doc: str = "doc") -> DataFrame:
    """key, valid, errors and warnings (arrays) of each batch of instances.

    Errors come part by part and item by item; a text that is no JSON object has one error. With a JSON schema its
    violations follow the others (see schemas.violations for the keywords); keywords it does not know are warnings.
    """
    found = structural_errors(instances, key, doc)
    order = F.struct("part", "position", "missing")
    said = F.concat(F.lit("missing "), F.col("missing"), F.lit(" in "), F.when(F.col("part") == "entities", "entity").otherwise("reaction"))
    lists = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), said.alias("s")))), lambda x: x["s"]).alias("_found"))
    none = F.array().cast("array<string>")
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(doc))).startswith("OBJECT"), F.lit(False))
    errors = F.when(readable, F.coalesce("_found", none)).otherwise(F.array(F.lit("no JSON object")))
    out = instances.select(key, doc).join(lists, key, "left").withColumn("errors", errors)
    warnings: list[str] = []
    if schema is not None:
        warnings = schemas.unknown(schema)
        out = out.withColumn("errors", F.when(readable, F.concat("errors", schemas.checker(schema)(F.col(doc)))).otherwise(F.col("errors")))
    return out.select(key, (F.size("errors") == 0).alias("valid"), "errors", F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"))


def structural_errors(instances: DataFrame, key: str = "batch_id", doc: str = "doc", parts: tuple[str, ...] = ("entities", "reactions")) -> DataFrame:
    """key, part, position and missing field of each entity and reaction that lacks class or displayName.

    A field that is present but null is not missing.
    """
    v = F.try_parse_json(F.col(doc))
    rows = None
    for part in parts:
        items = F.try_variant_get(v, f"$.{part}", "array<map<string,variant>>")
        flat = instances.select(key, F.lit(part).alias("part"), F.posexplode(items).alias("position", "item"))
        rows = flat if rows is None else rows.unionByName(flat)
    fields = F.explode(F.array(F.lit("class"), F.lit("displayName"))).alias("missing")
    return rows.select(key, "part", F.col("position").cast("long").alias("position"), "item", fields).where(~F.map_contains_key("item", F.col("missing"))).drop("item")


def instance_counts(instances: DataFrame, key: str = "batch_id", doc: str = "doc", papers: bool = False) -> DataFrame:
    """Entities, reactions, pathways and all instances of each batch, and its papers if asked for; a missing list has none."""
    v = F.try_parse_json(F.col(doc))
    count = lambda p: F.coalesce(F.size(F.try_variant_get(v, f"$.{p}", "array<variant>")), F.lit(0)).cast("long")
    more = [count("papers").alias("papers")] if papers else []
    return instances.select(key, *more, *[count(p).alias(p) for p in ("entities", "reactions", "pathways")], (count("entities") + count("reactions") + count("pathways")).alias("instances"))
