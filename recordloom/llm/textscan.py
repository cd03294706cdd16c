"""Words of a batch of texts as numpy arrays: boundaries, 64-bit word hashes and hashes of word runs.

A word is a run of bytes outside a separator table. Hashes are seedless, so equal words hash alike in every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once; a longer text is scanned alone.
CHUNK = 2 << 20
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=_U)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = {"p": np.ones(1, _U), "q": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 .. B^(n-1) and their inverses modulo 2^64."""
    if len(_pow["p"]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        for k, base in (("p", _B), ("q", _BINV)):
            x = np.full(size, base, _U)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow["p"][:n], _pow["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Words:
    """starts, ends: byte ranges of words; doc: a word's text; first[d]: text d's first word; hash: of each word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, separators: np.ndarray = SPACES):
        if lower:
            data = LOWER[data]
        self.data, self.off, n = data, off, len(data)
        on = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = on[:-1]
        self.starts = np.flatnonzero(on & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = on[1:]
        self.ends = np.flatnonzero(on & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hash(self) -> np.ndarray:
        padded = np.zeros(len(self.data) + 16, np.uint8)
        padded[: len(self.data)] = self.data
        eights = np.ndarray((len(self.data) + 8,), "<u8", padded, 0, (1,))
        size = self.ends - self.starts
        h = mix(size.astype(_U) * _U(_B))
        live, k = np.arange(len(size)), 0
        while len(live):
            left = np.minimum(size[live] - 8 * k, 8)
            h[live] = mix(h[live] * _U(_B) ^ (eights[self.starts[live] + 8 * k] & _MASKS[left]))
            k += 1
            live = live[size[live] > 8 * k]
        return h

    def runs(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of words i .. i+k-1 for each i that has k words behind it in the batch; texts' ends are not heeded."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, _U)
        p, q = powers(len(h) + 1)
        c = np.zeros(len(h) + 1, _U)
        np.cumsum(h * p[: len(h)], out=c[1:])
        return mix((c[k:] - c[:n]) * q[:n])

    def whole(self, k: int) -> np.ndarray:
        """True for each i whose run of k words ends in its own text."""
        n = max(0, len(self) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about size bytes."""
    data, off = text_buffer(col)
    n, a = len(col), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
