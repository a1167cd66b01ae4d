"""A dense matrix of vectors on disk: blocks of neighbouring rows as raw floats, and a table that says whose row is whose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.graph import numbered

ROWS_SCHEMA = "row long, db_id long, display_name string, start_index string"
BLOCK_SCHEMA = "block long, first long, n int, dims int, data binary"
#: Rows of a block.
BLOCK = 4096


def save_matrix(chunks: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write chunks (db_id, display_name, start_index, embedding) as a matrix, a row each, to path/rows and path/blocks.

    Rows are in order of (db_id, start as a number, start, name). An unknown start is '-1'; a chunk without a vector, and
    components that are null, are NaN. A block is its rows' little-endian 32-bit floats one after the other, so it can be
    mapped as it is.
    """
    start = F.coalesce(F.col("start_index").cast("string"), F.lit("-1"))
    rows = chunks.select("db_id", "display_name", start.alias("start_index"), start.try_cast("long").alias("_start"), F.col("embedding").cast("array<float>").alias("embedding"))
    placed = numbered(rows, "db_id", "_start", "start_index", "display_name", ord="row")
    placed.select("row", "db_id", "display_name", "start_index").write.mode("overwrite").parquet(f"{path}/rows")
    dims = placed.agg(F.max(F.size("embedding"))).first()[0] or 0

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        out = np.full((len(pdf), max(dims, 0)), np.nan, "<f4")
        for i, v in enumerate(pdf["embedding"]):
            if v is not None:
                out[i, : len(v)] = np.array(v, dtype=float)
        return pd.DataFrame({"block": pdf["row"].iloc[:1] // block, "first": pdf["row"].iloc[:1], "n": [len(pdf)], "dims": [max(dims, 0)], "data": [out.tobytes()]})

    blocks = placed.select("row", "embedding", F.expr(f"row div {block}").alias("block")).groupBy("block").applyInPandas(packed, BLOCK_SCHEMA)
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")


def matrix_blocks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The blocks that hold rows first to last; both bounds are pushed into the scan."""
    out = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    out = out if last is None else out.where(F.col("first") <= last)
    return out if first is None else out.where(F.col("first") + F.col("n") > first)


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """row, db_id, display_name, start_index and vector of every row of a saved matrix."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, n, dims, data in zip(pdf["first"], pdf["n"], pdf["dims"], pdf["data"], strict=True):
                yield pd.DataFrame({"row": np.arange(first, first + n), "vector": list(np.frombuffer(data, "<f4").reshape(n, dims))})

    vectors = matrix_blocks(spark, path).mapInPandas(unpacked, "row long, vector array<float>")
    return spark.read.schema(ROWS_SCHEMA).parquet(f"{path}/rows").join(vectors, "row")
