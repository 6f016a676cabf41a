"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text in a slice: its arrays take about 50 bytes for each.
_PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at white space only.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(9, 14)]] = False

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(batch: pa.RecordBatch, column: str, most: int = _PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or of one row."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    ends, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            ends.append((start, i))
            start, total = i, 0
        total += n
    if len(sizes):
        ends.append((start, len(sizes)))
    for a, b in ends:
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """The first n powers; kept, of twice as many as before at least, so that a worker holds what its slices need."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 0 if have is None else min(2 * len(have), _PIECE + 64)), U(base), dtype=np.uint64)
        steps[:1] = U(1)
        _powers[kind] = have = np.cumprod(steps, out=steps)
    return have[:n]


class Words:
    """Words of a slice: ``start`` and ``end`` in ``data``, and the text each is ``of``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = PLAIN):
        self.data, self.offsets = data, offsets
        n = len(data)
        mask = inside[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin, last = mask.copy(), mask.copy()
        if n:
            begin[1:] &= ~mask[:-1] | first[1:n]
            last[:-1] &= ~mask[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.of = np.searchsorted(offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.of, minlength=len(offsets) - 1).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end)."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    back = _power("down", _BACK, n + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
