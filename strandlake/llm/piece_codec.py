"""SentencePiece encoding and decoding by batched Viterbi.

A text is normalised as the vocabulary says (identity: a leading space, spaces written as U+2581) and cut before every
run of spaces, which no piece crosses. The distinct words of a batch are grouped by length and each group advances
through its characters together: substring hashes probe the sorted keys of each piece length, hits are confirmed
character by character, and vectorised maxima over the ending pieces store scores and backpointers. The best path
maximises the sum of the file's piece scores; of equal paths the one with the longer last piece wins. Characters
without a piece become byte pieces, so decoding gives back every text, but that U+2581 comes back as a space, as with
the library.

The scores of a merge vocabulary are ranks, so these ids are the vocabulary's best-scored segmentation, not the result of
its merges.

Edge cases: null and empty texts have no ids and decode to the empty text; long words without spaces take a scalar
path with the same result; repeated rows get equal ids; an empty table gives an empty result; other columns are kept
and the added one gets a free name.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from strandlake.llm import tokenizer
from strandlake.llm.common import documents, free_name

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Fewer words of one length than this take the scalar path; a block of words has at most BLOCK characters.
FEW, BLOCK = 24, 60_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as sorted substring keys by piece length."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        names = [file.id_to_piece(i) for i in range(n)]
        special = [file.is_control(i) or file.is_unknown(i) or file.is_unused(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if file.is_byte(i)}
        plain = [i for i in range(n) if not special[i] and not file.is_byte(i)]
        self.score = np.array([file.get_score(i) for i in range(n)], np.float32)
        self.unknown = np.float32(min(self.score[i] for i in plain) - np.float32(UNKNOWN_PENALTY))
        self.id_of = {names[i]: i for i in plain}
        self.raw = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if file.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece crosses a space: words cannot be encoded alone")
        self.longest = max(map(len, self.id_of))
        self.n_letters = [len(x) for x in names]
        self.by_length = {}
        for length in sorted({len(p) for p in self.id_of}):
            chosen = [i for i in plain if len(names[i]) == length]
            letters = _letters([names[i] for i in chosen], length)
            key = _prefix_hashes(letters)[:, -1]
            order = np.argsort(key)
            if len(np.unique(key)) != len(key):
                raise ValueError("two pieces share a hash")
            self.by_length[length] = key[order], np.array(chosen)[order], letters[order]


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)


def _prefix_hashes(letters: np.ndarray) -> np.ndarray:
    h = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    for j in range(letters.shape[1]):
        h[:, j + 1] = h[:, j] * _BASE + letters[:, j] + np.uint64(1)
    return h


def viterbi_one(v: Pieces, word: str) -> list[int]:
    """Ids of one word, character by character; -1 stands for a character without a piece."""
    n = len(word)
    best, back = [np.float32(0)] + [None] * n, [(0, -1)] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - v.longest), j):
            piece = v.id_of.get(word[i:j], None)
            if piece is None:
                if j - i > 1:
                    continue
                piece, score = -1, v.unknown
            else:
                score = v.score[piece]
            total = best[i] + score
            if best[j] is None or total > best[j]:
                best[j], back[j] = total, (i, piece)
    out, j = [], n
    while j:
        j, piece = back[j]
        out.append(piece)
    return out[::-1]


def viterbi_block(v: Pieces, letters: np.ndarray) -> np.ndarray:
    """Ids of words of one length, all at once: a row per word, right-aligned; -2 pads, -1 has no piece."""
    m, n = letters.shape
    h, top = _prefix_hashes(letters), min(n, v.longest)
    # [end, slot, word]: slot top - length holds the piece of that length that ends there.
    score = np.full((n + 1, top, m), -np.inf, np.float32)
    ids = np.full((n + 1, top, m), -1, np.int32)
    score[1:, top - 1] = v.unknown
    for length in (x for x in v.by_length if x <= top):
        keys, chosen, spelled = v.by_length[length]
        probe = h[:, length:] - h[:, : n - length + 1] * np.uint64(pow(int(_BASE), length, 1 << 64))
        at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
        row, col = np.nonzero(keys[at] == probe)
        hit = at[row, col]
        same = (letters[row[:, None], col[:, None] + np.arange(length)] == spelled[hit]).all(axis=1)
        row, col, hit = row[same], col[same], chosen[hit[same]]
        score[col + length, top - length, row], ids[col + length, top - length, row] = v.score[hit], hit
    best, slot = np.zeros((n + 1, m), np.float32), np.zeros((n + 1, m), np.int8)
    for j in range(1, n + 1):
        first = max(0, top - j)
        total = score[j, first:] + best[j - (top - first) : j]
        slot[j] = total.argmax(axis=0) + first  # of equal paths the longest last piece
        best[j] = total.max(axis=0)
    out = np.full((m, n), -2, np.int32)
    place, rows = np.full(m, n), np.arange(m)
    for k in range(n - 1, -1, -1):
        rows = rows[place[rows] > 0]
        if not len(rows):
            break
        end = place[rows]
        took = slot[end, rows]
        out[rows, k] = ids[end, took, rows]
        place[rows] = end - (top - took)
    return out


def _spelled_out(v: Pieces, word: str, ids: list[int]) -> bytes:
    """Ids with byte pieces for the characters (-1) that have no piece."""
    flat, at = [], 0
    for x in ids:
        if x >= 0:
            flat.append(x)
            at += v.n_letters[x]
        else:
            flat += [v.byte_ids[b] for b in word[at].encode()]
            at += 1
    return np.array(flat, "<i4").tobytes()


def encode_words(v: Pieces, words: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each word."""
    found = [b""] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, members in by_length.items():
        if len(members) < FEW or length > BLOCK:
            for i in members:
                found[i] = _spelled_out(v, words[i], viterbi_one(v, words[i]))
            continue
        step = max(FEW, BLOCK // length)
        for a in range(0, len(members), step):
            part = members[a : a + step]
            ids = viterbi_block(v, _letters([words[i] for i in part], length))
            real, odd = ids > -2, (ids == -1).any(axis=1)
            flat, cuts = ids[real].astype("<i4").tobytes(), np.append(0, np.cumsum(real.sum(axis=1)) * 4).tolist()
            for k, i in enumerate(part):
                found[i] = flat[cuts[k] : cuts[k + 1]]
            for k in np.flatnonzero(odd).tolist():
                found[part[k]] = _spelled_out(v, words[part[k]], ids[k][real[k]].tolist())
    return found


@functools.lru_cache(maxsize=2)
def codec(path: str) -> tuple[Pieces, tokenizer.Memo]:
    v = Pieces(path)
    return v, tokenizer.Memo(lambda words: encode_words(v, [SPACE + w for w in words]))


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    _, memo = codec(path)
    parts, seen = [], set()
    for text in texts:
        words = text.split(" ") if text else []
        if words and (SPACE in text or not all(words)):  # runs of spaces, or the mark itself, which reads as a space
            words = [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
        seen.update(words)
        parts.append(words)
    table = memo.with_all(seen)
    return [np.frombuffer(b"".join(map(table.__getitem__, words)), "<i4") for words in parts]


def decode_ids(path: str, ids: list[int]) -> str:
    raw = codec(path)[0].raw
    return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


def _parts(batches, rows: int = 256):
    """Short slices of Arrow batches, so that Python objects exist for a few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode(df: DataFrame, model: str, text: str = "text") -> tuple[DataFrame, str]:
    """df with a column (its name is returned) of the ids of its text."""
    name = free_name(df, "piece_ids")[0]
    at = df.columns.index(text)

    def run(batches):
        for part in _parts(batches):
            values = encode_texts(model, part.column(at).fill_null("").to_pylist())
            sizes = np.append(0, np.cumsum([len(x) for x in values])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(values), pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))])), name


def decode(df: DataFrame, model: str, ids: str) -> tuple[DataFrame, str]:
    """df with a column (its name is returned) of the text its ids stand for; null ids stand for the empty text."""
    name = free_name(df, "decoded")[0]
    at = df.columns.index(ids)

    def run(batches):
        for part in _parts(batches):
            texts = [decode_ids(model, x or []) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, StringType())])), name


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer.default_path("piece_bpe_32k.model")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"))
    coded, ids = encode(df, model)
    back, decoded = decode(coded.drop("text"), model, ids)
    return back.select("doc_id", "n_bytes", F.size(ids).cast("long").alias("n_pieces"), F.hash(ids).alias("ids_hash"), (F.md5(F.col(decoded).cast("binary")) == F.col("text_md5")).alias("round_trip"))
