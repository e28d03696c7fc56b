"""Many texts as one byte array: words, lines and their hashes without a Python step per word.

Every function here works on a slice of an Arrow batch with some hundred KB of text (or one longer
text), so a task's memory follows its longest text and not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
BLANK = np.isin(_BYTE, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
# Words of the two kinds the contracts name: runs without blanks, and runs of 0-9, a-z and all
# that is not ASCII (upper case is folded before).
NOT_BLANK = ~BLANK
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)

_random = np.random.default_rng(20_231)
_BYTE_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close inputs are far apart."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse, kept for the next slice."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [_power(_STEP, size), _power(_STEP_BACK, size)]
    forward, back = _powers
    if len(forward) > 4 * SLICE_BYTES:  # not kept: made for one very long text
        _powers.clear()
    return forward, back


class Texts(NamedTuple):
    """``data[offsets[i]:offsets[i + 1]]`` are the UTF-8 bytes of text i; a NULL text has none."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[off[0]:off[-1]], off - off[0])


def slices(batches, text: int | str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Pieces of the batches with at most ``limit`` bytes of text, or one row if that is longer."""
    for batch in batches:
        whole = texts_of(batch.column(text))
        start = 0
        while start < batch.num_rows:
            base = whole.offsets[start]
            stop = int(np.searchsorted(whole.offsets, base + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            off = whole.offsets[start:stop + 1]
            yield batch.slice(start, stop - start), Texts(whole.data[off[0]:off[-1]], off - off[0])
            start = stop


class Words(NamedTuple):
    """Byte spans of the words, the text of each, and the index of each text's first word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def _spans(inside: np.ndarray, t: Texts) -> Words:
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[t.offsets] = True
    cut[0] = cut[n] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, t.offsets)
    return Words(start, end, np.repeat(np.arange(t.rows), np.diff(first)), first)


def words(t: Texts, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of the kind, within one text each."""
    return _spans(kind[t.data], t)


def lines(t: Texts) -> Words:
    """The \\n-separated lines; an empty text is one empty line."""
    if t.rows == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(1, np.int64))
    breaks = np.flatnonzero(t.data == 10)
    row = np.searchsorted(t.offsets, breaks, side="right") - 1
    start = np.concatenate([t.offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(t.rows), row])
    order = np.lexsort((start, rows))
    start, rows = start[order], rows[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.flatnonzero(np.diff(rows, append=t.rows))
    end[last] = t.offsets[rows[last] + 1]
    return Words(start, end, rows, np.searchsorted(rows, np.arange(t.rows + 1)))


class Hasher:
    """64-bit hashes of any byte spans of a slice, from one running sum over its bytes."""

    def __init__(self, data: np.ndarray):
        forward, self._back = powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * forward[:len(data)], out=self._sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self._sum[end] - self._sum[start]) * self._back[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_JOIN = np.uint64(0xA24BAED4963EE407)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values; the caller drops those that cross texts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total = total * _JOIN + h[j:j + n]
    return mix(total)


def within(w: Words, size: int) -> np.ndarray:
    """Indices of the words at which a run of ``size`` words of one text starts."""
    n = len(w.row) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.row[:n] == w.row[size - 1:])


def covered(starts: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in a run of ``size`` words from any of the starts."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)[:n + 1]
    return np.cumsum(steps[:n]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text's words."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
