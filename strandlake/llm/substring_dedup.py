"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes decides after which blanks a chunk ends (about every third), so a passage is
cut alike wherever it stands and an insertion moves only the chunks it touches. What is deduplicated by digest over all
texts are windows: the shortest rows of neighbouring chunks that weigh at least MIN_WORDS words, one to the right of each
chunk and one to its left. A window whose digest stands elsewhere first goes, so all that goes stood in one piece of at
least MIN_WORDS words there, and the windows inside a passage cover all its whole chunks. A passage of over 50 words keeps
at least MIN_WORDS of them in whole chunks but for about one case in ten thousand; shorter repeats (headings, licence
lines) and texts without repeats stay as they are.

Stretches of 64 bytes without a blank may also be cut between characters; there SOLID_BYTES bytes weigh as much as
MIN_WORDS words, so long repeats without blanks go too. Digests have 64 bits: about n^2/2^65 windows among n distinct
ones may be taken for another, 0.1 at 30 GB.

Edge cases: null and empty texts stay; rows equal in id and text are one document and are not repeats of each other;
which place of a digest is the first depends on the row's hash, not on the order of rows; an empty table gives an empty
result; other columns are kept, and added ones get free names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandlake.llm import textkernel as tk
from strandlake.llm.chunks import reducers_for, repeated, with_row_key
from strandlake.llm.common import documents, free_name

MIN_WORDS = 20
WINDOW = 16
EVERY = 3
SOLID, SOLID_EVERY = 64, 31
SOLID_BYTES = 240

_GEAR = (tk.mix(np.arange(1000, 1256, dtype=tk.U)) & tk.U(0xFFFF)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last 16 bytes at each byte, by doubling the window four times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of every chunk of a run of texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, blank = gear(data), tk.BLANK[data]

    def deep(at: np.ndarray, depth: int) -> np.ndarray:
        """Those of the bytes at whose last `depth` bytes lie in one text."""
        return at[at - offsets[np.searchsorted(offsets, at, side="right") - 1] >= depth - 1]

    ends = [deep(np.flatnonzero(blank & (h % EVERY == 0)), WINDOW)]
    if len(data) > SOLID:
        blanks = np.cumsum(blank)
        at = np.flatnonzero((blanks[SOLID:] == blanks[:-SOLID]) & (h[SOLID:] % SOLID_EVERY == 0)) + SOLID
        at = deep(at[at + 1 < len(data)], SOLID + 1)
        ends.append(at[(data[at + 1] & 0xC0) != 0x80])
    start = np.concatenate(ends) + 1
    start = np.union1d(start[start < len(data)], offsets[:-1][np.diff(offsets) > 0])
    return start, np.searchsorted(offsets, start, side="right") - 1


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(digest, text, place in the text, start, end) of every window."""
    start, text = chunk_starts(data, offsets)
    if not len(start):
        return (np.zeros(0, tk.U),) + (np.zeros(0, np.int64),) * 4
    n = len(start)
    solid = ~tk.BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = solid[offsets[:-1][np.diff(offsets) > 0]]
    words = np.add.reduceat(begins.astype(np.int64), start)
    weight = np.where(words > 0, words * (SOLID_BYTES // MIN_WORDS), np.add.reduceat(solid.astype(np.int64), start))
    least = SOLID_BYTES // MIN_WORDS * MIN_WORDS
    upto = np.append(0, np.cumsum(weight))
    a = np.arange(n)
    b = np.searchsorted(upto, upto[:-1] + least)  # the window of chunks a..b-1 to the right of each start
    right = (b <= n) & (text[np.minimum(b, n) - 1] == text)
    c = np.searchsorted(upto, upto[1:] - least, side="right") - 1  # and c..a to the left of each end
    left = (c >= 0) & (text[np.maximum(c, 0)] == text)
    both = np.unique(np.concatenate([a[right] * (n + 1) + b[right], c[left] * (n + 1) + a[left] + 1]))
    a, b = both // (n + 1), both % (n + 1)
    power, inverse = tk.powers(len(data))
    sums = np.append(tk.U(0), np.cumsum(np.add.reduceat(tk.LETTER[data] * power[: len(data)], start), dtype=tk.U))
    bounds = np.append(start, len(data))
    return tk.mix((sums[b] - sums[a]) * inverse[start[a]]), text[a], np.arange(len(a)) - np.searchsorted(text[a], text[a]), start[a], bounds[b]


def segment(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, text, place in the text) of every window."""
    return windows(data, offsets)[:3]


def removed_spans(data: np.ndarray, places: list[int]) -> list[tuple[int, int]]:
    """Byte spans of one text that go; places are those of its windows that occur before."""
    start, end = windows(data, np.array([0, len(data)]))[3:]
    place = np.unique(np.array(places, np.int64))
    start, end = start[place], np.maximum.accumulate(end[place])
    opens = np.append(True, start[1:] > end[:-1])
    return list(zip(start[opens].tolist(), end[np.append(opens[1:], True)].tolist(), strict=True))


def dedup_substrings(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """df with its text cleaned and one added column (its name is returned): the removed byte spans of the old text."""
    keyed, h = with_row_key(df, key, text)
    marks_name, spans_name = free_name(keyed, "marks", "removed_spans")
    rows = keyed.select(F.col(h).alias("h"), F.col(f"`{text}`").alias("t"))
    found = repeated(rows, segment, reducers_for(df, text, 20))
    marks = found.where(~F.col("first")).groupBy("row").agg(F.collect_list("place").alias(marks_name)).withColumnRenamed("row", h)
    joined = keyed.join(marks, h, "left").drop(h)
    at, names = df.columns.index(text), df.columns
    schema = StructType([*df.schema.fields, StructField(spans_name, ArrayType(ArrayType(LongType())))])

    def clean(batches):
        for batch in batches:
            marks = batch.column(len(names))
            hit = marks.is_valid().to_pylist()
            texts, spans = batch.column(at), [[] for _ in range(len(hit))]
            if any(hit):
                out = texts.to_pylist()
                for i in (i for i, x in enumerate(hit) if x and out[i]):
                    raw = out[i].encode()
                    spans[i] = [list(s) for s in removed_spans(np.frombuffer(raw, np.uint8), marks[i].as_py())]
                    if spans[i]:
                        edges = [0, *(x for s in spans[i] for x in s), len(raw)]
                        out[i] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                texts = pa.array(out, texts.type)
            columns = [texts if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.list_(pa.int64())))], [*names, spans_name])

    return joined.select(*[F.col(f"`{c}`") for c in names], marks_name).mapInArrow(clean, schema), spans_name


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).select("doc_id", "text").withColumn("n_bytes", F.octet_length("text").cast("long"))
    out, spans = dedup_substrings(df)
    gone = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return out.select("doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), gone.alias("removed_bytes"), F.size(spans).alias("n_spans"), F.to_json(spans).alias("removed_spans"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
