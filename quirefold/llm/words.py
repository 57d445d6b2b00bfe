"""Words, word hashes and word-gram hashes of whole Arrow text columns, vectorised with numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` on UTF-8. All functions work on
the column's own byte buffer: no Python object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E6C63D0876A9A63 | 1
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = powers(_BASE, _BLOCK + 1), powers(pow(_BASE, -1, 2**64), _BLOCK + 1)


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets (int64, one more than rows); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if kind == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  #: the bytes
    starts: np.ndarray  #: byte offset of each word's first byte
    ends: np.ndarray  #: byte offset after each word's last byte
    first: np.ndarray  #: for each document the number of words before it; one more entry than documents

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The document's words (of those, the kept ones) joined by one space."""
        a, b = self.first[doc], self.first[doc + 1]
        if a == b:
            return b""
        text = self.data[self.starts[a] : self.ends[b - 1]].tobytes().split()
        return b" ".join(text if keep is None else [w for w, k in zip(text, keep.tolist(), strict=True) if k])


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hashes(words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, worked out over blocks of 256 KB."""
    out, n, at = np.empty(len(words.starts), np.uint64), len(words.starts), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(words.ends, words.starts[at] + _BLOCK, "right")))
        low, high = int(words.starts[at]), int(words.ends[to - 1])
        if high - low > _BLOCK:  # one huge word
            out[at] = _fold(words.data[low:high], lower)
        else:
            part = words.data[low:high]
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE_CODE[_LOWER[part] if lower else part] * _POW[: high - low], out=sums[1:])
            a, b = words.starts[at:to] - low, words.ends[at:to] - low
            out[at:to] = mix((sums[b] - sums[a]) * _INV[a] + (b - a).astype(np.uint64))
        at = to
    return out


def _fold(part: np.ndarray, lower: bool) -> np.uint64:
    total, scale = 0, 1
    for at in range(0, len(part), _BLOCK):
        piece = part[at : at + _BLOCK]
        total += scale * int((_BYTE_CODE[_LOWER[piece] if lower else piece] * _POW[: len(piece)]).sum(dtype=np.uint64))
        scale = scale * pow(_BASE, len(piece), 2**64) % 2**64
    return mix(np.array([(total + len(part)) % 2**64], np.uint64))[0]


def grams(values: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A hash of every n values in a row; len(values) - n + 1 of them, across document borders too."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    scale, total = powers(base | 1, n), np.zeros(len(values) - n + 1, np.uint64)
    for j in range(n):
        total += values[j : len(values) - n + 1 + j] * scale[j]
    return mix(total)


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of rows of about `limit` bytes, a longer row alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to
