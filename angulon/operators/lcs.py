"""Lengths of longest common subsequences of many pairs at once, by bit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAIRS, LETTERS = 1 << 16, 64


class Coded:
    """Sequences as numbers of letters, one after another; the number ``letters`` stands for none."""

    def __init__(self, seqs: list[str]):
        self.n = np.array([len(s) for s in seqs], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        every, codes = np.unique(np.frombuffer("".join(seqs).encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
        self.codes, self.letters = codes.astype(np.int64).ravel(), len(every)

    def counts(self) -> np.ndarray:
        """How often each letter occurs, letters beyond 64 folded: what two sequences have in common is at most the sum of the lesser counts."""
        width = max(1, min(self.letters, LETTERS))
        rows = np.repeat(np.arange(len(self.n)), self.n)
        return np.bincount(rows * width + self.codes % width, minlength=len(self.n) * width).reshape(-1, width).astype(np.int32)


def lengths(seqs: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCS lengths of the pairs (i, j), which should come in the order of i: a few sequences' letters are held as bits at a time."""
    out = np.empty(len(i), dtype=np.int64)
    at = 0
    while at < len(i):
        words = int(-(-seqs.n[i[at : at + PAIRS]].max() // 64)) or 1
        end = min(len(i), at + max(1, PAIRS // words))
        firsts = np.flatnonzero(np.diff(i[at:end], prepend=-1))
        most = max(1, (1 << 22) // ((seqs.letters + 1) * words))
        end = at + int(firsts[most]) if len(firsts) > most else end
        out[at:end] = _some(seqs, i[at:end], j[at:end], words)
        at = end
    return out


def _some(seqs: Coded, i: np.ndarray, j: np.ndarray, words: int) -> np.ndarray:
    own, row = np.unique(i, return_inverse=True)
    n = seqs.n[own]
    width = seqs.letters + 1
    place = np.concatenate([np.arange(x) for x in n]) if len(n) else np.empty(0, dtype=np.int64)
    source = np.repeat(seqs.at[own], n) + place
    bits = np.zeros((words, len(own) * width), dtype=np.uint64)
    np.bitwise_or.at(bits, (place >> 6, np.repeat(np.arange(len(own)), n) * width + seqs.codes[source]), np.uint64(1) << (place & 63).astype(np.uint64))
    order = np.argsort(-seqs.n[j], kind="stable")
    row, other = row[order].ravel() * width, j[order]
    m, start = seqs.n[other], seqs.at[other]
    left = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
    for k in range(int(m[0]) if len(m) else 0):
        active = int(np.searchsorted(-m, -k, side="left"))  # those longer than k
        letter = row[:active] + seqs.codes[start[:active] + k]
        carry = None
        for w in range(words):
            v = left[w][:active]
            u = v & bits[w][letter]
            total = v + u
            if words > 1:
                over = total < v
                if carry is not None:
                    more = total + carry
                    over |= more < total
                    total = more
                carry = over.astype(np.uint64)
            left[w][:active] = total | (v - u)
    size = seqs.n[i[order]]
    matched = np.zeros(len(i), dtype=np.int64)
    for w in range(words):
        inside = np.clip(size - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside & np.uint64(63))) - np.uint64(1))
        matched += np.bitwise_count(~left[w] & mask).astype(np.int64)
    out = np.empty(len(i), dtype=np.int64)
    out[order] = matched
    return out


def candidates(seqs: Coded, left: np.ndarray, right: np.ndarray, threshold: float, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose lengths and letters leave room for the threshold; once: left and right are the same, pairs i < j."""
    counts = seqs.counts()
    step = max(1, (1 << 20) // max(1, len(right)))
    for k in range(0, len(left), step):
        l = left[k : k + step]
        n, m = seqs.n[l][:, None].astype(float), seqs.n[right][None, :].astype(float)
        ok = np.minimum(n, m) >= threshold * threshold * np.maximum(n, m) - 1e-9
        common = np.zeros(ok.shape, dtype=np.int32)
        for c in range(counts.shape[1]):
            common += np.minimum(counts[l, c][:, None], counts[right, c][None, :])
        ok &= common >= threshold * np.sqrt(n * m) - 1e-9
        if once:
            ok &= l[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        yield l[x], right[y]
