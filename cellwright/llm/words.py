"""Words, hashes and slices of the texts in an Arrow batch, as numpy arrays.

All functions work on whole texts. A slice holds whole rows and about SLICE_BYTES of text, so memory
follows the slice or the longest text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: Powers up to this length, enough for a chunk, are kept by a worker; longer ones, for a single long text, are made each time and dropped.
KEPT = 5 << 18

# The six ASCII space characters that part words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=_U) | _U(1)

#: 0 for space, 1 for anything else.
WORD_CLASSES = np.ones(256, np.uint8)
WORD_CLASSES[list(SPACES)] = 0

#: As above, with ASCII punctuation as a class of its own.
TOKEN_CLASSES = WORD_CLASSES.copy()
TOKEN_CLASSES[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; every other byte stays."""
    return _LOWER[data]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their bytes and the row offsets in them. A null is an empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD_CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one class other than 0: their starts, their ends, and the bounds of each row in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(cut[:-1] & (kind != 0))
    ends = np.flatnonzero(cut[1:] & (kind != 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    out = values ^ (values >> _U(30))
    out = out * _U(0xBF58476D1CE4E5B9)
    out ^= out >> _U(27)
    out *= _U(0x94D049BB133111EB)
    return out ^ (out >> _U(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n if n > KEPT else min(KEPT, n + n // 4), base, _U)
        steps[0] = 1
        made.append(np.cumprod(steps, out=steps, dtype=_U))
    if n <= KEPT:
        _POWERS[:] = made
    return made


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of runs of values, modulo 2**64, from one prefix sum."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[:len(values)], out=sums[1:], dtype=_U)
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(run_hashes(_BYTE_CODES[data], starts, ends))


def window_starts(rows: np.ndarray, width: int) -> np.ndarray:
    """Where a run of `width` words of one row begins. rows: bounds of the rows."""
    n = int(rows[-1])
    room = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)
    return np.flatnonzero(room >= width)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and the bounds of the rows in them.

    A row with fewer words, but at least one, has its whole sequence as its only run.
    """
    count = np.diff(rows)
    starts = window_starts(rows, width)
    ends = starts + width
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        where = np.searchsorted(starts, rows[short])
        starts, ends = np.insert(starts, where, rows[short]), np.insert(ends, where, rows[short + 1])
    bounds = np.searchsorted(starts, rows)
    return mixed(run_hashes(words, starts, ends)), bounds
