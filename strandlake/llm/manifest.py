"""Merkle manifest of a dataset in an external-memory node store.

Leaves are ordered inside their part (a null part first, then bytewise) by a range partition; rows equal in everything
are interchangeable, so they travel as one row with a count. Positions come from the totals of the range runs and the
running count inside each. From there on all work is by coordinate (part, level, place), never by group: the nodes of a
level are stored as pages, each a row of up to 2^TIER neighbouring digests, in Parquet partitioned by level. Each level
reads the one before it once, from end to end, and halves every page where it lies, without a shuffle; after TIER levels
every page is one digest, and pages are gathered into new ones, a 2^TIER-th of the rows. The roots of the parts are the
leaves of one more tree of the same kind.

Proofs come from merge joins of pages by coordinate, from the top down: a tier's pages meet the stored pages of its
levels and the proof of the node they hang from, and give the proof of each of their own nodes. So a leaf's proof is read
from the store and never from other leaves, and a task holds one page of leaves and its 2 * 2^TIER digests, whatever the
table's size.

Edge cases: a null field counts as `-`, an empty one as `0:`; rows of one id are ordered by their leaves, null ids come
first; a lone last node becomes the digest of itself, a lone leaf is its part's root; a part or a table of one leaf has an
empty proof; a null id is never tampered with and a null n_chars stays; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandlake.llm.common import documents, materialise, named, scratch_path, shuffle_width

#: Levels between two gatherings: a page has at most 2^TIER nodes.
TIER = 12
#: What a step of a proof does with the digest so far: nothing stands beside it, or one to the right, or one to the left.
ALONE, RIGHT, LEFT = b"\0", b"\1", b"\2"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, a colon and its value."""
    said = []
    for f in fields:
        value = f.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def halved(digests: bytes) -> bytes:
    """The digests of every two neighbouring digests, in hex; the last may stand alone."""
    said = digests.hex().encode()
    return b"".join(hashlib.sha256(said[a : a + 128]).digest() for a in range(0, len(said), 128))


def folded(leaf: str, steps: list[tuple[bytes, str]]) -> str:
    """The root that a leaf and the steps of its proof lead to."""
    for side, other in steps:
        leaf = hashlib.sha256((leaf + other if side == RIGHT else other + leaf if side == LEFT else leaf).encode()).hexdigest()
    return leaf


@dataclass
class Tree:
    """A written tree for each part p: pages of leaves with their items, all levels, and one root a part."""

    leaves: DataFrame  # p, page, items (first, n, digest, carry)
    store: DataFrame  # p, page, nodes (of the part on this level), digests, level
    height: int

    def roots(self) -> DataFrame:
        """p, root and the level it stands on."""
        return self.store.where("nodes = 1").select("p", F.col("digests").alias("root"), "level")


def positions(rows: DataFrame) -> DataFrame:
    """p, first, n, digest, carry of rows (p, k, digest, carry): places first to first + n - 1 of the part."""
    met = rows.groupBy("p", "k", "digest", "carry").agg(F.count("*").alias("n"))
    order = ["k", "digest", "carry"]
    ranged = met.repartitionByRange(shuffle_width(rows.sparkSession), "p", *order).withColumn("run", F.spark_partition_id())
    ranged = materialise(ranged, "leaf_runs")
    totals = ranged.groupBy("p", "run").agg(F.sum("n").alias("total"))  # a row for each run of a part
    before = Window.partitionBy("p").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("p", "run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"), F.sum("total").over(Window.partitionBy("p")).alias("size"))
    inside = Window.partitionBy("p", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, ["p", "run"])
    return placed.select("p", (F.col("start") + F.col("before")).alias("first"), "n", "digest", "carry", "size")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Python values, one page at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [halved(d) for d in batch.column("digests").to_pylist()]
        nodes = [(n + 1) // 2 for n in batch.column("nodes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("page"), pa.array(nodes, pa.int64()), pa.array(digests, pa.binary())], ["p", "page", "nodes", "digests"])


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _one_by_one(batches):
        digests = b"".join(i["digest"] * i["n"] for i in row["items"])
        yield pa.RecordBatch.from_arrays([pa.array([row["p"]]), pa.array([row["page"]], pa.int64()), pa.array([row["nodes"]], pa.int64()), pa.array([digests], pa.binary())], ["p", "page", "nodes", "digests"])


def build(rows: DataFrame, name: str, tier: int = TIER) -> Tree:
    """The trees over rows (p string, k, digest binary, carry), one a part p, ordered by (k, digest, carry)."""
    spark, size = rows.sparkSession, 1 << tier
    placed = positions(rows)
    # A repeated row may cover any number of pages, and each page gets its share.
    page = F.explode(F.expr(f"sequence(first div {size}, (first + n - 1) div {size})"))
    cut = placed.withColumn("page", page).withColumn("from", F.greatest("first", F.col("page") * size))
    share = F.least(F.col("first") + F.col("n"), (F.col("page") + 1) * size) - F.col("from")
    item = F.struct(F.col("from").alias("first"), share.alias("n"), "digest", "carry")
    leaves = materialise(cut.groupBy("p", "page").agg(F.max("size").alias("nodes"), F.sort_array(F.collect_list(item)).alias("items")), f"{name}_leaves")
    most = leaves.agg(F.max("nodes")).first()[0] or 0
    height, kind = max(0, most - 1).bit_length(), "p string, page long, nodes long, digests binary"
    path = scratch_path(spark, f"{name}_nodes")
    level = leaves.select("p", "page", "nodes", "items").mapInArrow(_first_level, kind)
    for k in range(height + 1):
        if k:
            level = spark.read.schema(kind).parquet(f"{path}/level={k - 1}").where("nodes > 1").mapInArrow(_halves, kind)
            if k % tier == 0:  # every page is one digest by now
                gathered = level.groupBy("p", F.expr(f"page div {size}").alias("page")).agg(F.max("nodes").alias("nodes"), F.sort_array(F.collect_list(F.struct("page", "digests"))).alias("d"))
                level = gathered.select("p", "page", "nodes", F.aggregate("d", F.lit(b""), lambda a, x: F.concat(a, x["digests"])).alias("digests"))
        level.write.parquet(f"{path}/level={k}")
    return Tree(leaves, spark.read.schema(kind + ", level int").option("basePath", path).parquet(path), height)


def local_steps(levels: list[tuple[int, str]], at: int) -> list[tuple[bytes, str]]:
    """The steps of a page's node: levels has (nodes of the part, digests of the page in hex) from the page's level up."""
    out = []
    for nodes, said in levels:
        if nodes == 1:
            break
        beside = (at ^ 1) * 64
        other = said[beside : beside + 64]
        out.append(((LEFT if at & 1 else RIGHT) if other else ALONE, other))
        at >>= 1
    return out


def _packed(steps: list[tuple[bytes, str]]) -> bytes:
    return b"".join(side + bytes.fromhex(other or "00" * 32) for side, other in steps)


def _unpacked(path: bytes) -> list[tuple[bytes, str]]:
    parts = (path[a : a + 33] for a in range(0, len(path), 33))
    return [(x[:1], "" if x[:1] == ALONE else x[1:].hex()) for x in parts]


def _levels(blobs: list[dict]) -> list[tuple[int, str]]:
    return [(b["nodes"], b["digests"].hex()) for b in blobs]


def _tier_pages(tree: Tree, t: int, tier: int) -> DataFrame:
    """p, page and the stored pages of a tier's levels, lowest level first."""
    mine = tree.store.where(F.col("level").between(t * tier, (t + 1) * tier - 1))
    return mine.groupBy("p", "page").agg(F.sort_array(F.collect_list(F.struct("level", "nodes", "digests"))).alias("blobs"))


def hanging(tree: Tree, above: DataFrame, tier: int = TIER) -> DataFrame:
    """p, page, blobs, items of every page of leaves with path, subroot and root: the proof from the page up.

    above has p, path, subroot, root: what lies above each part's own root.
    """
    path_kind = "p string, page long, path binary, subroot binary, root binary"

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            levels = _levels(row["blobs"])
            n = len(levels[0][1]) // 64
            paths = [_packed(local_steps(levels, i)) + row["path"] for i in range(n)]
            first = row["page"] << tier
            columns = [pa.array([row["p"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(paths, pa.binary()), pa.array([row["subroot"]] * n, pa.binary()), pa.array([row["root"]] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["p", "page", "path", "subroot", "root"])

    ends = materialise(above.join(tree.roots().select("p", F.expr(f"level div {tier}").alias("t")), "p").select("p", F.lit(0).cast("long").alias("page"), "path", "subroot", "root", "t"), "above")
    upper = None
    for t in range(tree.height // tier, -1, -1):
        ending = ends.where(F.col("t") == t).drop("t")
        upper = ending if upper is None else upper.unionByName(ending)
        met = _tier_pages(tree, t, tier).join(upper, ["p", "page"])
        if t == 0:
            return met.join(tree.leaves.select("p", "page", "items"), ["p", "page"])
        upper = materialise(met.mapInArrow(down, path_kind), f"proofs_{t}")


def manifest(rows: DataFrame, tier: int = TIER) -> DataFrame:
    """k, leaf, subroot, root, proof_sha256 and folded_root (hex) of rows (part, k, digest, tampered).

    tampered is a changed leaf to fold in place of the own one, or null.
    """
    # A null part is '', others have a mark in front: so parts sort as they should and join as plain keys.
    keyed = rows.select(F.coalesce(F.concat(F.lit("+"), F.col("part").cast("string")), F.lit("")).alias("p"), "k", "digest", F.col("tampered").alias("carry"))
    id_kind, id_type = keyed.schema["k"].dataType.simpleString(), to_arrow_type(keyed.schema["k"].dataType)
    inner = build(keyed.withColumn("carry", F.struct("k", F.col("carry").alias("tampered"))), "parts", tier)
    subroots = inner.roots().select(F.lit("").alias("p"), F.col("p").alias("k"), F.col("root").alias("digest"))
    outer = build(subroots.withColumn("carry", F.struct("k")), "top", tier)
    nothing = outer.roots().select("p", F.lit(b"").alias("path"), F.col("root").alias("subroot"), "root")

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            levels, out = _levels(row["blobs"]), []
            for item in row["items"]:
                at = item["first"] - (row["page"] << tier)
                out.append((item["carry"]["k"], _packed(local_steps(levels, at)) + row["path"], item["digest"], row["root"]))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["p", "path", "subroot", "root"])

    above = hanging(outer, nothing, tier).mapInArrow(of_parts, "p string, path binary, subroot binary, root binary")

    def of_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            levels, upper = _levels(row["blobs"]), _unpacked(row["path"])
            subroot, root, out = row["subroot"].hex(), row["root"].hex(), []
            for item in row["items"]:
                leaf, changed = item["digest"].hex(), item["carry"]["tampered"]
                first = item["first"] - (row["page"] << tier)
                for at in range(first, first + item["n"]):
                    steps = local_steps(levels, at) + upper
                    proof = hashlib.sha256("".join(other for _, other in steps).encode()).hexdigest()
                    out.append((item["carry"]["k"], leaf, subroot, root, proof, folded(changed.hex() if changed else leaf, steps)))
            names = ["k", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            yield pa.RecordBatch.from_arrays([pa.array(c, id_type if i == 0 else pa.string()) for i, c in enumerate(zip(*out, strict=True))], names)

    return hanging(inner, above, tier).mapInArrow(of_leaves, f"k {id_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [named(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [c + F.lit(1) if i == 3 else c for i, c in enumerate(fields)]
    hit = F.crc32(fields[0].cast("string").cast("binary")) % 7 == 0
    rows = documents(spark, sf_dir).select(named("lang").alias("part"), named("doc_id").alias("k"), leaf_digest(*fields).alias("digest"), F.when(hit, leaf_digest(*changed)).alias("tampered"))
    out = manifest(rows)
    return out.withColumnRenamed("k", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


#: The trees as lists a lang, halved level by level; CRC-32 from a table made by its rule (polynomial 0xEDB88320).
OP13_SQL = """
with recursive tab as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256))::bigint as i))
), f as (
  select doc_id, lang, n_chars, case when lang is null then '' else concat('+', lang) end as p,
    concat(coalesce(concat(strlen(doc_id::varchar), ':', doc_id::varchar), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-')) as head,
    coalesce(concat(strlen(text), ':', text), '-') as tail, coalesce(concat(strlen(n_chars::varchar), ':', n_chars::varchar), '-') as size, coalesce(concat(strlen((n_chars + 1)::varchar), ':', (n_chars + 1)::varchar), '-') as more,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as crc
  from documents, tab
), h as (select doc_id, p, sha256(concat(head, size, tail)) as leaf, case when crc % 7 = 0 then sha256(concat(head, more, tail)) end as tampered from f),
o as (select *, row_number() over (partition by p order by doc_id nulls first, leaf, tampered nulls first) - 1 as i from h),
tree(p, level, nodes) as (
  select p, 0, list(leaf order by i) from o group by p
  union all
  select p, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda x: sha256(concat(nodes[2 * x + 1], coalesce(nodes[2 * x + 2], '')))) from tree where len(nodes) > 1
), sub as (select p, nodes[1] as subroot, level as height, row_number() over (order by p) - 1 as i from tree where len(nodes) = 1),
top(level, nodes) as (
  select 0, list(subroot order by p) from sub
  union all
  select level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda x: sha256(concat(nodes[2 * x + 1], coalesce(nodes[2 * x + 2], '')))) from top where len(nodes) > 1
), rt as (select nodes[1] as root, level as height from top where len(nodes) = 1),
pl as (select p, list(nodes order by level) as ls from tree group by p), tl as (select list(nodes order by level) as ls from top),
st as (
  select o.*, sub.subroot, rt.root,
    list_concat(list_transform(range(0, sub.height), lambda k: case when (o.i >> k) % 2 = 1 then concat('L', pl.ls[k + 1][(o.i >> k)]) else concat('R', coalesce(pl.ls[k + 1][(o.i >> k) + 2], '')) end),
                list_transform(range(0, rt.height), lambda k: case when (sub.i >> k) % 2 = 1 then concat('L', tl.ls[k + 1][(sub.i >> k)]) else concat('R', coalesce(tl.ls[k + 1][(sub.i >> k) + 2], '')) end)) as steps
  from o join sub on sub.p = o.p join pl on pl.p = o.p, rt, tl
), fo as (
  select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(steps, lambda s: s[2:]), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), steps), lambda a, s: case when s[1] = 'L' then sha256(concat(s[2:], a)) else sha256(concat(a, s[2:])) end) as folded_root
  from st
)
select *, folded_root = root as verified from fo
"""
