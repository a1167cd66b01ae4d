"""Vectorised words and hashes over Arrow text columns: no Python object per word.

Texts are handled in runs of at most about RUN bytes (one longer text makes a run of its own), so memory follows the
longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN = 1 << 20
U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


#: One number per byte value; blanks count nothing in a word's hash.
LETTER = mix(np.arange(1, 257, dtype=U))
WORD_LETTER = np.where(BLANK, U(0), LETTER)


def powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, RUN)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers


def runs(column: pa.Array):
    """(first row, bytes, offsets) of successive runs of rows; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def segment_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A position-independent hash of values[start : next start] for each start; zeros at a segment's end add nothing."""
    if not len(starts):
        return np.zeros(0, U)
    power, inverse = powers(len(values))
    return mix(np.add.reduceat(values * power[: len(values)], starts) * inverse[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-blank bytes inside one text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[(offsets < len(data))]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    edge[-1] = True
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the words at start, A-Z taken as a-z."""
    return segment_hashes(WORD_LETTER[LOWER[data]], start)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-word shingles of each text, by row and then by hash.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    start, _, row = words(data, offsets)
    hashes = word_hashes(data, start)
    count = np.bincount(row, minlength=len(offsets) - 1)
    factor = U(0xD6E8FEB86659FD93)
    if len(hashes) >= n:
        m = len(hashes) - n + 1
        whole = np.zeros(m, U)
        for k in range(n):
            whole = whole * factor + hashes[k : k + m]
        inside = row[n - 1 :] == row[:m]
        sh, sr = mix(whole[inside]), row[:m][inside]
    else:
        sh, sr = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        extra = []
        for r, f in zip(short, first, strict=True):
            h = int(count[r])
            for x in hashes[f : f + count[r]].tolist():
                h = (h * int(factor) + x) & 0xFFFFFFFFFFFFFFFF
            extra.append(h)
        sh, sr = np.concatenate([sh, mix(np.array(extra, U) ^ U(0x5BD1E995))]), np.concatenate([sr, short])
        order = np.argsort(sr, kind="stable")
        sh, sr = sh[order], sr[order]
    bounds = np.searchsorted(sr, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        sh[a:b].sort()
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    return sh[keep], sr[keep]
