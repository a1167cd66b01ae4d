"""Token counts through a digest cache.

A stored count is known by the digest of the normalised content (a null text is the empty text; nothing else changes)
and the digest of the tokenizer's version. Only distinct contents the cache lacks are encoded, to the library's own
counts (see tokenizer); their counts are appended to it and every row is answered from it.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and copies are encoded once and each get
their count; an empty table gives an empty result and appends nothing; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import tokenizer
from strandlake.llm.common import documents, materialise, named, scratch_path

LIMIT = 4096
CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def count_tokens(df: DataFrame, model: str, cache: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and n_tokens of every row.

    cache is a Parquet folder all executors share, made where it is missing. Without it the cache is a new folder of this
    call, so every distinct text is encoded once. Calls that append to one cache at the same time may store a count
    twice, which changes no result.
    """
    spark, version = df.sparkSession, tokenizer.version(model)
    cache = cache or scratch_path(spark, "counts")
    rows = df.select(named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("t"))
    digest = F.unhex(F.sha2(F.col("t").cast("binary"), 256))

    def cached() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = cached()
    missing = rows.select(digest.alias("digest"), "t").join(known, "digest", "left_anti")
    missing = missing.groupBy("digest").agg(F.first("t").alias("t"))  # copies meet in the map tasks first

    def encode(batches):
        count = tokenizer.counter(model)
        for batch in batches:
            n = [x for part in tokenizer.slices(batch.column("t").to_pylist()) for x in count(part)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    missing.mapInArrow(encode, "digest binary, n_tokens long").select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    sized = rows.select("k", F.octet_length("t").cast("long").alias("n_bytes"), digest.alias("digest"))
    # A written table on both sides lets Spark split the partition of a digest that very many rows have.
    return sized.join(materialise(cached(), "counts"), "digest").select(F.col("k").alias(key), "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir), tokenizer.default_path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
