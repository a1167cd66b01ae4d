"""Contiguous shards of equal bytes from global prefix sums.

Only (id, size, checksum) rows are range-partitioned and written to the shared folder; each partition's total is
summed to one row, the totals are cumulated, and a row's global start is the total before its partition plus the
running sum inside it. A row's midpoint against equal targets names its shard, so shards are contiguous in id order
and their sizes differ by less than the largest text.

Edge cases: a null text has no bytes; sizes are at least 1, so the total is positive unless the table is empty, which
gives an empty result; repeated rows and null ids (they sort first) are placed like any other; rows equal in id, size
and checksum are interchangeable, so they travel as one row with a count and are told apart by the place they get;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import documents, materialise, named, shuffle_width

SHARDS = 16
#: Equal rows that one task places at a time.
COPIES = 1 << 20


def shard_by_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, shard and slot (place in the shard) of every row."""
    spark = df.sparkSession
    body = F.coalesce(named(text), F.lit(""))
    rows = df.select(named(key).alias("k"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    rows = rows.groupBy("k", "size", "crc").agg(F.count("*").alias("n"))
    ranged = rows.repartitionByRange(shuffle_width(spark), "k", "size", "crc").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")

    # One row per partition: its count grows with the partitions, not with the rows.
    totals = ranged.groupBy("part").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))

    earlier = Window.partitionBy("part").orderBy("k", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for name, c in (("upto", F.col("size") * F.col("n")), ("nth", F.col("n")))]
    at = ranged.select("*", *sums).join(totals, "part").select("k", "size", "crc", "n", (F.col("bytes0") + F.col("upto")).alias("start"), (F.col("rows0") + F.col("nth")).alias("place"), "total")
    # The copies of a row that very many equal, in stretches that any task may take.
    stretch = F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")).alias("from")
    few = at.where(F.col("n") <= COPIES).withColumn("from", F.lit(0).cast("long"))
    at = few.unionByName(at.where(F.col("n") > COPIES).select("*", stretch).repartition(shuffle_width(spark)))
    copy = F.explode(F.expr(f"sequence(from, least(n, from + {COPIES}) - 1)")).alias("copy")
    target = F.expr(f"((2 * (start + copy * size) + size) * {shards}) div (2 * total)")  # of the row's midpoint
    placed = at.select("*", copy).select("k", "size", "crc", F.least(target, F.lit(shards - 1)).cast("int").alias("shard"), (F.col("place") + F.col("copy")).alias("place"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most `shards` rows
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Window sums over all rows; CRC-32 byte by byte from a table made by its rule (polynomial 0xEDB88320).
OP4_SQL = """
with tab as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256))::bigint as i))
), b as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, hex(encode(coalesce(text, ''))) as h from documents),
c as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'), lambda x: (instr('0123456789ABCDEF', x[1]) * 16 + instr('0123456789ABCDEF', x[2]) - 17)::bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as text_crc32
  from b, tab
), p as (
  select *, sum(size) over (order by doc_id, size, text_crc32 rows unbounded preceding) as upto, sum(size) over () as total, row_number() over (order by doc_id, size, text_crc32) as place from c
), s as (select *, least(15, ((2 * upto - size) * 16) // (2 * total))::int as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, (place - min(place) over (partition by shard))::bigint as slot, null::int as grown_shard from s
"""
