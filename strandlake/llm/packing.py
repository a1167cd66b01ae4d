"""Sequences of at most 1024 tokens by minimum bin slack.

Texts are encoded once, cut only where they are longer than a sequence, and written to the shared folder as rows of
lengths and checksums. Pieces of one length are interchangeable, so packing works on the table of lengths (at most
1024 rows, whatever the input): per bin the longest piece left is placed, and a bitset subset-sum over the lengths left
finds the combination that fills the rest furthest. That combination stays the fullest while its pieces last, so it is
taken as often as the counts allow at once. Each piece then finds its bin from its rank among pieces of its length;
ranks come from counts per task, so no length is gathered anywhere.

Edge cases: a null or empty text is one piece that holds only the closing id; repeated rows are packed as separate
documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import tokenizer
from strandlake.llm.common import documents, materialise, named

CAPACITY = 1024
END = 2


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, after a shorter first piece if one is needed."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination of available lengths with the largest sum up to room.

    Bit s of the set tells that the lengths so far can make s. Longer lengths come first and the walk back takes as few
    of the shorter ones as it can, so small pieces last for later bins.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        steps.append((length, bits))
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            bits |= (bits << (length * take)) & mask
            left, chunk = left - take, chunk * 2
        if bits >> room:
            break
    target, out = bits.bit_length() - 1, []
    for length, before in reversed(steps):
        copies = 0
        while not before >> (target - copies * length) & 1:
            copies += 1
        if copies:
            out.append((length, copies))
            target -= copies * length
    return out


@dataclass
class Segments:
    """For each length, runs of ranks that one combination takes: ordered by (length, first rank)."""

    key: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 50) | rank, side="right") - 1
        nth = rank - (self.key[at] & ((1 << 50) - 1))
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Segments:
    """Minimum bin slack over a table of lengths."""
    left = {k: n for k, n in counts.items() if n}
    used, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = dict(fullest(left, capacity - longest))
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times, offset = min(left[x] // c for x, c in combination.items()), 0
        for x, c in sorted(combination.items(), reverse=True):
            rows.append(((x << 50) | used[x], c, sequence, offset))
            used[x] += c * times
            offset += c * x
            left[x] -= c * times
            if not left[x]:
                del left[x]
        sequence += times
    rows.sort()
    return Segments(*(np.array(c, np.int64) for c in zip(*rows, strict=True))) if rows else Segments(*[np.zeros(0, np.int64)] * 4)


def encode_pieces(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """k, piece, start, length, crc of every piece, with the task that made it and its rank there among its length."""

    def encode(batches):
        ids, task, seen = tokenizer.id_bytes(model), TaskContext.get().partitionId(), [0] * (capacity + 1)
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for keys, texts in zip(tokenizer.slices(batch.column("k").to_pylist()), tokenizer.slices(batch.column("t").to_pylist()), strict=True):
                for k, coded in zip(keys, ids(texts), strict=True):
                    coded = memoryview(coded + closing)
                    for piece, (start, length) in enumerate(cut(len(coded) // 4, capacity)):
                        rows.append((k, piece, start, length, zlib.crc32(coded[4 * start : 4 * (start + length)]), seen[length]))
                        seen[length] += 1
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field("k").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(rows), pa.int32())], ["k", "piece", "start", "length", "crc", "nth", "task"])

    rows = df.select(named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(encode, f"k {kind}, piece int, start long, length long, crc long, nth long, task int")


def pack(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = materialise(encode_pieces(df, model, key, text, capacity, end), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    segments = plan({r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches):
        for pdf in batches:
            sequence, offset = segments.place(pdf["length"].to_numpy(), pdf["rank"].to_numpy())
            yield pd.DataFrame({"k": pdf["k"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "crc": pdf["crc"], "sequence_id": sequence, "offset": offset})

    kind = pieces.schema["k"].dataType.simpleString()
    placed = ranked.select("k", "piece", "start", "length", "crc", "rank").mapInPandas(place, f"k {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")
    return placed.select(F.col("k").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer.default_path("byte_bpe_50k.json"))
