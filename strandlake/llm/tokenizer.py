"""Whole-text encoding by public tokenizers.

Byte-level ids: where a tokenizers file is a plain byte-level merge list (each merge made the next id), tiktoken's
encoder runs on those merges, which gives the same ids about four times as fast; any other file, and any text that
tiktoken refuses (runs of hundreds of thousands of blanks), runs in tokenizers.

Piece counts: where a sentencepiece vocabulary has no piece that joins characters across a space and leaves characters
as they are (both are checked when the model is loaded), a text without runs of spaces is counted word by word, and
words seen lately come from a bounded table. All other texts go whole to the library, such with U+2581, which it reads as
a space, among them.
"""

from __future__ import annotations

import functools
import hashlib
import json

#: Words kept in each of two generations per worker: a full one becomes the old one, which is asked before it goes.
TABLE = 80_000
#: Longer words are encoded but not kept.
LONG = 64

#: Fixed value: the split pattern of byte-level vocabularies of this family, with possessive quantifiers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """A digest of the vocabulary file and the library that reads it."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read())
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    digest.update(f"{library.__name__} {library.__version__}".encode())
    return digest.hexdigest()


class Memo:
    """word -> value of the last words, by an encoder of lists."""

    def __init__(self, encode):
        self.encode, self.new, self.old = encode, {}, {}

    def with_all(self, words: set[str]) -> dict:
        """A table that has every word of words."""
        if len(self.new) > TABLE:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = words.difference(new)
        wanted = []
        for w in missing:
            if w in old:
                new[w] = old[w]
            else:
                wanted.append(w)
        if not wanted:
            return new
        long = {}
        for w, v in zip(wanted, self.encode(wanted), strict=True):
            (new if len(w) <= LONG else long)[w] = v
        return {**new, **long} if long else new


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins byte-level vocabularies write for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def _merge_encoder(path: str):
    """tiktoken's encoder on the file's merges, or None where the file is no plain byte-level merge list."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or model.get("dropout") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in spec["added_tokens"]):
        return None
    letters, vocab, special = _byte_letters(), model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def id_bytes(path: str):
    """texts -> their ids as little-endian unsigned 32-bit integers, as tokenizers gives them."""
    import numpy as np
    from tokenizers import Tokenizer

    coder, library = _merge_encoder(path), functools.cache(lambda: Tokenizer.from_file(path))

    def by_library(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in library().encode_batch(texts, add_special_tokens=False)]

    def by_merges(text: str) -> bytes:
        try:
            return coder.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern needs more stack than it has
            return by_library([text])[0]

    return by_library if coder is None else lambda texts: [by_merges(t) for t in texts]


#: U+2581, which sentencepiece writes for a space.
SPACE = "\u2581"


def words_are_apart(library) -> bool:
    """Whether no piece joins characters across a space and every character but the space stands for itself."""
    pieces = (library.id_to_piece(i) for i in range(library.get_piece_size()))
    if any(SPACE in p[1:] and p.strip(SPACE) for p in pieces):
        return False
    others = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in (" ", SPACE))
    return library.normalize(others) == SPACE + others and library.normalize("a b") == f"{SPACE}a{SPACE}b"


@functools.lru_cache(maxsize=4)
def piece_counts(path: str):
    """texts -> their numbers of pieces, by the sentencepiece library."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    # The library puts a space before what it encodes: a word after a space is counted without that space.
    memo = Memo(lambda words: [len(x) for x in library.encode(words, num_threads=1)])
    if not words_are_apart(library):
        return lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]

    def count(texts: list[str]) -> list[int]:
        parts, words = [], set()
        for text in texts:
            if "  " in text or text[:1] == " " or text[-1:] == " " or not text or SPACE in text or "\0" in text:
                parts.append(text)  # runs of spaces are pieces of their own: the library takes such a text whole
            else:
                parts.append(text.split(" "))
                words.update(parts[-1])
        at = memo.with_all(words)
        return [sum(map(at.__getitem__, p)) if isinstance(p, list) else len(library.encode(p)) for p in parts]

    return count


def counter(path: str):
    """texts -> numbers of tokens, by the library the file belongs to."""
    if path.endswith(".model"):
        return piece_counts(path)
    ids = id_bytes(path)
    return lambda texts: [len(x) // 4 for x in ids(texts)]


def slices(values: list, size: int = 128):
    for i in range(0, len(values), size):
        yield values[i : i + size]
