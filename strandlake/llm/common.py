"""Shared folder, materialised tables and column-name helpers for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
#: Most bytes of a broadcast bit table.
FILTER_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and driver and executors are one process (local tests) a temporary folder is set;
    on a cluster an unset folder is an error.
    """
    found = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError(f"set {SHARED} to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandlake-"))
            checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get()
    return found.rstrip("/")


#: The folders made inside each open scratch() block.
_blocks: list[list[str]] = []


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the session ends, or the innermost scratch() block."""
    folder = f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}"
    system, where = _folder(spark, folder)
    system.deleteOnExit(where)
    if _blocks:
        _blocks[-1].append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch(spark: SparkSession):
    """Tables made inside the block go when it ends: whatever reads them must be computed by then."""
    _blocks.append([])
    try:
        yield
    finally:
        for path in _blocks.pop():
            system, where = _folder(spark, path)
            system.delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by materialise() that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        system, where = _folder(df.sparkSession, parent)
        system.delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value, body):
    """body applied to value that is computed once: binds it to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bit_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table of the hashes h of ids and its number of bits.

    16 bits a hash up to FILTER_BYTES; with more hashes the table only gets fuller and lets more rows through, so its
    users must still join for the exact rows.
    """
    bits, count = 1 << 16, ids.count()
    while bits < 16 * count and bits < 8 * FILTER_BYTES:
        bits *= 2
    masks = ids.select(F.expr(f"pmod(h, {bits}) div 64").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))").alias("m"))
    found = masks.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64)
    return table.view(np.uint64), bits


def passes(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = np.mod(h, bits)
    return (table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
