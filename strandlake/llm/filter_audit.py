"""Audit of how filters overlap, over every order in which they may be applied.

Of n filters every order is a path through the lattice of applied subsets: its steps are edges (subset already applied,
next filter), n * 2^(n-1) of them (80 for five), and all n! * n steps (600) run over these edges only. So each document
is counted on edges once: rows meet by (part, failed set, labels) in the map tasks, at most 2^n * 4 rows a part go on,
each stands for its documents on all edges, and the edge sums are joined to the steps of the paths. What a step keeps or
removes depends on its edge alone; a filter's Shapley sum is that of its edges over all paths.

Whether a text stands under a smaller id is decided by (SHA-256 of the text, id): the smallest id of each digest comes
from a pre-aggregated group, and rows find it by digest and id together, so copies of one text are never dealt to one
task.

Edge cases: a null text is the empty text, which fails A and perhaps E; null ids are neither smaller nor larger than
others, so such rows repeat nothing and are repeated by nothing; rows of one id and text don't repeat each other; several label rows of one id count as one that has what any of them has; an id without labels has
neither; a null part counts as the empty string; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import documents, let, materialise, named

BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column) -> Column:
    """The failed text rules as bits: A few words, B repeated words, C capitals, D markup characters."""

    def bits(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        rules = [n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
        mask = F.lit(0)
        for i, failed in enumerate(rules):
            mask = mask + F.when(failed, 1 << i).otherwise(0)
        return mask

    return let(F.filter(F.split(text, BLANKS), lambda w: w != ""), bits)


def edges_of(n: int) -> list[tuple[int, int]]:
    """(applied subset, next filter) of every lattice edge."""
    return [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def paths_of(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, applied subset, next filter) of every step of every order."""
    out = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[x] for x in order), step, applied, f))
            applied |= 1 << f
    return out


def audit(rows: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step, the six counts and shapley of rows (part, failed, good, toxic, n).

    A row stands for n documents; failed has bit i set where they fail filter names[i]. Orders are all permutations of
    names, so there should be few filters: the steps are 600 for five and 4,320 for six.
    """
    spark = rows.sparkSession
    cells = rows.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(1 << f).alias("bit")) for s, f in edges_of(len(names))]))
    on = cells.select("*", edge.alias("e")).select("*", "e.*")
    fails, reached = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("applied")) == 0
    when = {
        "kept": reached & ~fails,
        "removed": reached & fails,
        "redundant": ~reached & fails,
        "unique_fails": F.col("failed") == F.col("bit"),
        "good_lost": reached & fails & F.col("good"),
        "toxic_lost": reached & fails & F.col("toxic"),
    }
    sums = on.groupBy("part", "applied", "next").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in when.items()])
    paths = spark.createDataFrame(paths_of(names), "filter_order string, step int, applied int, next int")
    steps = sums.join(F.broadcast(paths), ["applied", "next"])  # a fixed table: one row a step of an order
    shapley = F.sum("removed").over(Window.partitionBy("part", "next"))  # one row an order
    return steps.withColumn("shapley", shapley).select("part", "filter_order", "step", *COUNTS, "shapley")


def later_copies(rows: DataFrame) -> DataFrame:
    """rows (k, digest, ...) with repeated: whether the digest also stands under a smaller k."""
    smallest = rows.where(F.col("k").isNotNull()).groupBy("digest").agg(F.min("k").alias("k"), F.lit(True).alias("first"))
    met = rows.join(smallest, ["digest", "k"], "left")
    return met.withColumn("repeated", F.col("k").isNotNull() & F.col("first").isNull()).drop("first")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(named("text"), F.lit(""))
    read = documents(spark, sf_dir).select(F.col("doc_id").alias("k"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("failed"))
    # Repeated rows meet here; the texts are read once, since what follows starts from a written table.
    seen = materialise(read.groupBy("k", "part", "digest", "failed").agg(F.count("*").alias("n")), "failures")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("doc_id").isNotNull())
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    labels = labels.groupBy(F.col("doc_id").alias("k")).agg(has("quality"), has("toxic"))
    known = later_copies(seen).join(labels, "k", "left")
    failed = F.col("failed") + F.when(F.col("repeated"), 16).otherwise(0)
    no = F.lit(False)
    rows = known.select("part", failed.alias("failed"), F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    return audit(rows, "ABCDE")


#: Five failure columns, all 120 orders and a count over every (document, order, step).
OP12_SQL = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), lb as (select doc_id, max((quality = 1)::int) = 1 as good, max((toxic = 1)::int) = 1 as toxic from labels group by doc_id),
f as (
  select w.part, coalesce(lb.good, false) as good, coalesce(lb.toxic, false) as toxic,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(w.doc_id > min(w.doc_id) over (partition by t), false)] as fail
  from w left join lb on lb.doc_id = w.doc_id
), c as (select part, good, toxic, fail, count(*) as n from f group by all),
v as (select unnest([1, 2, 3, 4, 5]) as x),
o as (select [a.x, b.x, c.x, d.x, e.x] as p from v a, v b, v c, v d, v e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select p, list_aggregate(list_transform(p, lambda x: 'ABCDE'[x]), 'string_agg', '') as filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
e as (
  select c.*, s.filter_order, s.step, s.p[s.step] as x, c.fail[s.p[s.step]] as fails, len(list_filter(s.p[1:s.step - 1], lambda y: c.fail[y])) > 0 as gone, len(list_filter(c.fail, lambda y: y)) as n_fails from c, s
), r as (
  select part, filter_order, step, x, sum(case when not gone and not fails then n else 0 end)::bigint as kept, sum(case when not gone and fails then n else 0 end)::bigint as removed,
    sum(case when gone and fails then n else 0 end)::bigint as redundant, sum(case when fails and n_fails = 1 then n else 0 end)::bigint as unique_fails,
    sum(case when not gone and fails and good then n else 0 end)::bigint as good_lost, sum(case when not gone and fails and toxic then n else 0 end)::bigint as toxic_lost
  from e group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from r
"""
