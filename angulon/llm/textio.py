"""Vectorised views of Arrow text columns: byte chunks, whitespace words and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit values (xor-shift and multiply, twice)."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & _MASK)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class _Powers:
    """Powers of the rolling base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down


_POWERS = _Powers()
_CODES = mix(np.arange(256, dtype=np.uint64), 1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: What a byte adds to a hash, with A-Z as a-z.
LOWER_CODES, CODES = _CODES[_LOWER], _CODES
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi, the UTF-8 bytes of their texts, and the texts' offsets in these. Null counts as empty.

    A chunk ends before it would pass ``most`` bytes; a longer text is a chunk of its own, whole.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number per row of the maximal runs of true bytes, none of which crosses a row's end."""
    n = len(inside)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    start = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitespace words: start, end, and number in each row."""
    return runs(~SPACE[data], offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial of the bytes, from prefix sums, then mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * down[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * up[end] + (end - start).astype(np.uint64))


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows without values give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return total[ends[1:]] - total[ends[:-1]]
