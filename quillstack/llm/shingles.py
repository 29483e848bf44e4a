"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

Words are the maximal runs of bytes other than space and 0x09-0x0D after lower-casing A-Z. A text's set holds its distinct
runs of ``k`` words; with fewer words, the whole sequence as one; without words, nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the well-known two-multiply finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte array. No word may cross the ends of the array."""
    inside = ~_IS_BLANK[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    body = np.flatnonzero(inside)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(body)) - np.repeat(begins, lengths)
    value = _BYTE_VALUE[raw[body]] * _powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(value, begins) + lengths.astype(np.uint64)), starts


def _sets_of(words: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes for each stretch of words between two bounds."""
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled += words[j : len(words) - k + 1 + j] * _PLACE[j]
        rolled = mix64(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif n:
            yield mix64((words[a:b] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """One set for each value of a string column, in order; null has the empty set. Works on about a megabyte at a time."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_string())
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        offsets = np.frombuffer(chunk.buffers()[1], np.int64, count=len(chunk) + 1, offset=8 * chunk.offset)
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            to = min(to, len(chunk))
            raw = data[offsets[at] : offsets[to]]
            # A blank between two texts keeps their last and first words apart.
            gaps = (offsets[at + 1 : to] - offsets[at]).astype(np.int64)
            raw = np.insert(raw, gaps, 0x20) if len(gaps) else raw
            hashes, starts = word_hashes(raw)
            ends = np.concatenate((gaps + np.arange(len(gaps)), [len(raw)]))
            bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
            yield from _sets_of(hashes, bounds, k)
            at = to


class MinHasher:
    """``bands`` x ``rows`` minima of multiplied shingle hashes: a key for each band and ``bits`` low bits of each minimum."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, self.bits = bands, rows, bits
        self.factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)

    def minima(self, values: np.ndarray) -> np.ndarray:
        best = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), 512):
            np.minimum(best, np.multiply.outer(self.factors, values[at : at + 512]).min(axis=1), out=best)
        return mix64(best)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A key for each band; ``minima`` has a row for each set."""
        folded = (minima.reshape(len(minima), self.bands, self.rows) * self.places).sum(axis=2)
        return mix64(folded + np.arange(self.bands, dtype=np.uint64) * _BASE).view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """``bits`` low bits of each minimum as bit planes, each filled up to whole 64-bit words."""
        planes = []
        for b in range(self.bits):
            plane = np.packbits(((minima >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1)
            planes.append(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8))))
        return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)
