"""Encoding and decoding by a merge vocabulary with word ends, in batched numpy merge rounds.

A text is cut at the vocabulary's special strings; each part is normalised (NFC, white space to a space, lower case) and
split into words as the file says. The distinct words that a worker has not met lately are merged together: the symbols
of all of them stand in one flat array, every round forms the keys of all neighbouring pairs, finds their ranks by binary
search over the sorted pair keys, takes each word's lowest rank by a segmented minimum and replaces its pairs of that
rank, from left to right; words without a pair left leave the array. That equals merging one pair at a time where no
merge that takes a new symbol ranks before the merge that made it, which is checked when the file is read; otherwise a round
merges a word's first pair only. Words of more than LONG symbols, for which a round a rank would be too slow, merge by a
heap of (rank, place) over linked symbols, with the same result.

Decoding is that of a file without a decoder: the tokens' strings with a space between them.

The library's Unicode tables are older than Python's. A part with characters that are not in Unicode 3.2, whose
classes both agree on, is normalised and split by the library's own normaliser and splitter; its words are merged here
like all others.

Edge cases: null and empty texts, and texts of blanks only, have no ids and decode to the empty text; repeated rows get
equal ids; an empty table gives an empty result; other columns are kept and added ones get free names. Ids are kept as
arrays, so one text has at most 2^31 of them; memory follows SLICE bytes of text or the longest one.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from strandlake.llm import tokenizer
from strandlake.llm.common import documents, free_name, named

#: Symbols of a word that merges in rounds; symbols of one block of rounds; bytes of text handled together.
LONG, BLOCK, SLICE = 192, 1 << 19, 4 << 20
#: Rank of a pair that does not merge.
NEVER = np.iinfo(np.int64).max

#: The steps this module knows how to take, as the vocabulary file writes them.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What SPLIT says of lower-case ASCII text.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def _unfamiliar() -> re.Pattern:
    """Finds a character that Unicode 3.2 does not have."""
    old, ranges, start = unicodedata.ucd_3_2_0, [], None
    for c in range(sys.maxunicode + 2):
        missing = c <= sys.maxunicode and old.category(chr(c)) == "Cn"
        if missing and start is None:
            start = c
        elif not missing and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(ranges) + "]")


class Merges:
    """A merge vocabulary: sorted pair keys with rank and result, and the tokens' strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        known = model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"] and not model["continuing_subword_prefix"] and spec["decoder"] is None
        known = known and spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER} and steps == ["Split", "ByteLevel"]
        known = known and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"]
        if not known or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} asks for steps that are not known here")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        self.width = max(self.strings) + 1
        letters = {b: c for c, b in tokenizer._byte_letters().items()}
        #: The id of each byte inside a word, and at its end.
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in column], np.int64) for column in zip(*[(a, b, a + b) for a, b in pairs], strict=True))
        key = left * self.width + right
        order = np.argsort(key)
        self.keys, self.ranks, self.result = key[order], order.astype(np.int64), made
        rank, maker = np.arange(len(made)), np.full(self.width, -1, np.int64)
        np.maximum.at(maker, made, rank)
        self.ordered = bool((maker[left] < rank).all() and (maker[right] < rank).all())
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._words, self._unfamiliar = regex.compile(SPLIT), _unfamiliar()
        library = Tokenizer.from_file(path)
        self._normalizer, self._splitter = library.normalizer, library.pre_tokenizer
        self._bytes = {c: b for b, c in letters.items()}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, by binary search."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    @functools.cached_property
    def table(self) -> dict[tuple[int, int], int]:
        """Ranks by pair, for words that merge by a heap."""
        return {(k // self.width, k % self.width): r for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)}

    def words(self, part: str) -> list[str]:
        """The words of a part of a text without special strings.

        White space separates words whatever it is, so it need not be made a space first.
        """
        if part.isascii():
            return ASCII_SPLIT.findall(part.lower())
        if self._unfamiliar.search(part):
            split = self._splitter.pre_tokenize_str(self._normalizer.normalize_str(part))
            return [bytes(self._bytes[c] for c in word).decode() for word, _ in split]
        # A final sigma is lower-cased like any other, character by character.
        return self._words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def parts(self, text: str) -> list:
        """Lists of words and, between them, ids of special strings."""
        if self._cut is None or not self._cut.search(text):
            return [self.words(text)]
        out, upto = [], 0
        for m in self._cut.finditer(text):
            out += [self.words(text[upto : m.start()]), self.special[m.group()]]
            upto = m.end()
        return [*out, self.words(text[upto:])]

    def symbols(self, word: bytes) -> np.ndarray:
        out = self.byte[np.frombuffer(word, np.uint8)]
        out[-1] = self.last[word[-1]]
        return out

    def encode_words(self, said: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        words = [w.encode() for w in said]
        out: list[bytes] = [b""] * len(words)
        block, size = [], 0
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):
            if len(words[i]) > LONG:
                out[i] = merged_by_heap(self, self.symbols(words[i]).tolist())
                continue
            block.append(i)
            size += len(words[i])
            if size > BLOCK:
                self._rounds(words, block, out)
                block, size = [], 0
        if block:
            self._rounds(words, block, out)
        return out

    def _rounds(self, words: list[bytes], block: list[int], out: list[bytes]) -> None:
        lengths = np.array([len(words[i]) for i in block])
        data = np.frombuffer(b"".join(words[i] for i in block), np.uint8)
        symbols, ends = self.byte[data], np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word, block_ids = np.repeat(np.arange(len(block)), lengths), np.array(block)
        while True:
            # The last symbol of a word has no pair, so every word keeps a place in the segmented minimum.
            rank = np.full(len(symbols), NEVER)
            if len(symbols) > 1:
                rank[:-1] = np.where(word[1:] == word[:-1], self.rank(symbols[:-1], symbols[1:]), NEVER)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NEVER
            sizes = np.diff(np.append(starts, len(symbols)))
            if done.any():
                raw, finished = symbols.astype("<u4").tobytes(), np.flatnonzero(done)
                for a, n, w in zip(starts[finished].tolist(), sizes[finished].tolist(), block_ids[word[starts[finished]]].tolist(), strict=True):
                    out[w] = raw[4 * a : 4 * (a + n)]
                if done.all():
                    return
                going = np.repeat(~done, sizes)
                symbols, word, rank, lowest, sizes = symbols[going], word[going], rank[going], lowest[~done], sizes[~done]
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            if self.ordered:  # of overlapping pairs (a a a) every second one, from the left of each run
                run = np.cumsum(np.diff(at, prepend=-2) != 1)
                place = np.arange(len(at)) - np.searchsorted(run, run)
                at = at[place % 2 == 0]
            else:
                at = at[np.diff(word[at], prepend=-1) != 0]
            symbols[at] = self.result[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]


def merged_by_heap(merges: Merges, symbols: list[int]) -> bytes:
    """The ids of one long word: the lowest (rank, place) first, over linked symbols."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    flat = np.array(symbols)
    rank = merges.rank(flat[:-1], flat[1:])
    heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(rank.tolist()) if r != NEVER]
    heapq.heapify(heap)
    table = merges.table

    def offer(i: int) -> None:
        r = table.get((symbols[i], symbols[after[i]]))
        if r is not None:
            heapq.heappush(heap, (r, i, symbols[i], symbols[after[i]]))

    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j], after[i] = int(merges.result[r]), -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return np.array([s for s in symbols if s >= 0], "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> their ids as little-endian unsigned 32-bit integers; words met lately come from a bounded table."""
    merges = merges_of(path)
    memo = tokenizer.Memo(merges.encode_words)

    def encode(texts: list[str]) -> list[bytes]:
        cut = [merges.parts(t) for t in texts]
        at = memo.with_all({w for parts in cut for p in parts if isinstance(p, list) for w in p})
        return [b"".join(b"".join(map(at.__getitem__, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in parts) for parts in cut]

    return encode


def decoded(path: str, ids: bytes) -> str:
    """The tokens' strings with a space between them; ids the vocabulary lacks are left out."""
    strings = merges_of(path).strings
    return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist() if i in strings])


def by_bytes(texts: list[str], most: int = SLICE) -> Iterator[list[str]]:
    """texts in slices of about `most` characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(df: DataFrame, model: str, text: str = "text") -> tuple[DataFrame, str]:
    """df with one added column (its name is returned): the ids of its text."""
    name = free_name(df, "bpe_ids")[0]
    names, at, schema = df.columns, df.columns.index(text), StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))])

    def run(batches):
        ids_of = encoder(model)
        for batch in batches:
            row = 0
            for part in by_bytes(batch.column(at).fill_null("").to_pylist()):
                raw = ids_of(part)
                offsets = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                rows = batch.slice(row, len(part))
                row += len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*names, name])

    return df.mapInArrow(run, schema), name


def decode(df: DataFrame, model: str, ids: str) -> tuple[DataFrame, str]:
    """df with one added column (its name is returned): the text that the array column ids decodes to; null is empty."""
    name = free_name(df, "decoded")[0]
    names, at, schema = df.columns, df.columns.index(ids), StructType([*df.schema.fields, StructField(name, StringType())])

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                rows = batch.slice(row, 64)
                texts = [decoded(model, np.array(x or [], "<u4").tobytes()) for x in rows.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*names, name])

    return df.mapInArrow(run, schema), name


def digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row, in one pass: no ids leave the task."""
    rows = df.select(named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("t"))

    def run(batches):
        ids_of = encoder(model)
        for batch in batches:
            row = 0
            for part in by_bytes(batch.column("t").to_pylist()):
                raw = ids_of(part)
                said = [hashlib.sha256(decoded(model, x).encode()).hexdigest() for x in raw]
                columns = [batch.column("k").slice(row, len(part)), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array(said)]
                row += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer.default_path("word_bpe_49k.json"))
