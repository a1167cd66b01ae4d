"""Repeated content-defined chunks: where each repeated chunk stands and which of its places is the first.

Mappers deal packed (digest, row, place) arrays to reducers. A mapper keeps all but the first of its own copies of a
digest back: they are repeats whatever the others hold, and go to any reducer. So a chunk that a third of all rows
share reaches its reducer once per mapper batch, and no task gathers its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import textkernel as tk
from strandlake.llm.common import free_name, shuffle_width

U = tk.U
REDUCER_BYTES, MAPPER_ROWS = 48 << 20, 1 << 20
_ENTRY = np.dtype([("digest", "<u8"), ("row", "<u8"), ("place", "<u4"), ("many", "u1"), ("loose", "u1")])


def with_row_key(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """df with a 64-bit key of (id, text): rows equal in both are one document."""
    name = free_name(df, "row_key")[0]
    return df.withColumn(name, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))), name


def reducers_for(df: DataFrame, text: str, bytes_per_entry: int) -> int:
    """Reducers that hold about REDUCER_BYTES each, from the bytes of all texts."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(shuffle_width(df.sparkSession), -(-total * _ENTRY.itemsize // bytes_per_entry // REDUCER_BYTES))


def _sorted(e: np.ndarray) -> np.ndarray:
    """Entries by digest, row, place, each place once."""
    e = e[np.lexsort((e["place"], e["row"], e["digest"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["digest"][1:] != e["digest"][:-1]) | (e["row"][1:] != e["row"][:-1]) | (e["place"][1:] != e["place"][:-1])
    return e[new]


def _first_of_digest(e: np.ndarray) -> np.ndarray:
    first = np.ones(len(e), bool)
    first[1:] = e["digest"][1:] != e["digest"][:-1]
    return first


def repeated(rows: DataFrame, segment, reducers: int) -> DataFrame:
    """digest, row, place, first of every chunk that occurs at least twice; rows has h (row key) and t (text).

    segment(data, offsets) gives (digest, text, place) arrays of one run of texts. The first of a digest's places is the
    one with the smallest (row key, place).
    """

    def pack(entries: np.ndarray) -> pa.RecordBatch:
        e = _sorted(entries)
        first = _first_of_digest(e)
        at = np.flatnonzero(first)
        sizes = np.diff(np.append(at, len(e)))
        e["many"] = np.repeat(sizes > 1, sizes)
        e["loose"] = ~first
        target = np.where(first, ((e["digest"] >> U(32)) * U(reducers)) >> U(32), e["row"] % U(reducers)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        e, target = e[order], target[order]
        cuts = np.searchsorted(target, np.arange(reducers + 1))
        filled = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([e[cuts[t] : cuts[t + 1]].tobytes() for t in filled], pa.binary())], ["target", "entries"])

    def deal(batches):
        held, count = [], 0
        for batch in batches:
            keys = batch.column("h").to_numpy().view(U)
            for first, data, offsets in tk.runs(batch.column("t")):
                digest, text, place = segment(data, offsets)
                e = np.zeros(len(digest), _ENTRY)
                e["digest"], e["row"], e["place"] = digest, keys[first + text], place
                held.append(e)
                count += len(e)
                if count > MAPPER_ROWS:
                    yield pack(np.concatenate(held))
                    held, count = [], 0
        if count:
            yield pack(np.concatenate(held))

    def out(e: np.ndarray, first: np.ndarray):
        for a in range(0, len(e), 1 << 16):
            part = e[a : a + (1 << 16)]
            columns = [np.ascontiguousarray(part["digest"]).view(np.int64), np.ascontiguousarray(part["row"]).view(np.int64), part["place"].astype(np.int64), first[a : a + (1 << 16)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digest", "row", "place", "first"])

    def gather(batches):
        held = []
        for batch in batches:
            for blob in batch.column("entries"):
                e = np.frombuffer(blob.as_buffer(), _ENTRY)
                loose = e["loose"] == 1
                yield from out(e[loose], np.zeros(int(loose.sum()), bool))
                held.append(e[~loose])
        if not held:
            return
        e = np.concatenate(held)
        e = e[np.lexsort((e["place"], e["row"], e["digest"]))]
        first = _first_of_digest(e)
        at = np.flatnonzero(first)
        sizes = np.diff(np.append(at, len(e)))
        # A row that stands in several batches comes several times; it repeats only if its place or row differs.
        new = np.ones(len(e), bool)
        new[1:] = first[1:] | (e["row"][1:] != e["row"][:-1]) | (e["place"][1:] != e["place"][:-1])
        distinct, many = np.add.reduceat(new.astype(np.int64), at), np.maximum.reduceat(e["many"], at)
        keep = np.repeat((distinct > 1) | (many > 0), sizes) & new
        yield from out(e[keep], first[keep])

    dealt = rows.select("h", "t").mapInArrow(deal, "target int, entries binary").repartitionById(reducers, "target").select("entries")
    return dealt.mapInArrow(gather, "digest long, row long, place long, first boolean")
