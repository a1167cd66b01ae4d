"""A corpus pipeline: filter, deduplicate three ways, pack into sequences.

Every stage takes (spark, docs, sf_dir) with the columns of documents; all but the last return those columns. A stage
that rewrites texts drops a document only when nothing of it is left, and sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import tokenizer
from strandlake.llm.common import documents, release, scratch, scratch_path
from strandlake.llm.jaccard_join import near_components
from strandlake.llm.line_dedup import dedup_lines
from strandlake.llm.packing import pack
from strandlake.llm.quality import keep_good
from strandlake.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return keep_good(docs)


def _rewritten(docs: DataFrame, touched) -> DataFrame:
    left = docs.where(~(touched & (F.trim(F.coalesce(F.col("text"), F.lit(""))) == "")))
    return left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stand elsewhere first."""
    cleaned, removed = dedup_lines(docs.select(*COLUMNS))
    return _rewritten(cleaned, F.col(removed) > 0)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row, of those with the smallest id the one with the smallest hash.

    Rows equal in every column are one document, and one of them stays, with or without words.
    """
    row = F.struct(F.col("doc_id"), F.xxhash64(*COLUMNS).alias("hash")).alias("row")
    keyed = docs.select(*COLUMNS, row)
    kept = near_components(keyed, "row").where(F.col("row") == F.col("component_id")).select("row").distinct()
    return keyed.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere first."""
    cleaned, spans = dedup_substrings(docs.select(*COLUMNS))
    return _rewritten(cleaned, F.size(spans) > 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return pack(docs, tokenizer.default_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: Rolling hashes and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next.

    What a stage writes on its way goes when its result is written, and that when the next one's is.
    """
    docs, written = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "_"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if written is not None:
            release(written)
        docs = written = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
