"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A text is its words (runs of bytes other than white space, A-Z in lower case). A word's input is the sum of the vector
of its hash and the mean of the vectors of its character pairs, its edges being characters too; the pairs of words of
more than LONG bytes are counted first, so that a word of any length costs no more than its distinct pairs. Windows of
WINDOW words overlap by half and cover the whole text, however long; in each, a gated recurrent network reads the words
in both directions, attention weights pool the states, and a logistic unit scores the pool. The text's score is that of
its most toxic window (of equal ones the first). Null and empty texts are one window without words: their score is that
of the zero pool. Equal texts have equal scores, in whatever rows; ids may be null; other columns play no part.

Trained in numpy by back-propagation through time on at most ``sample`` labelled ids (lowest hash first; of several
texts of an id that of the lowest hash), of these as many as have ``most_bytes`` of text together: both are documented
bounds of the labelled sample. Each step takes texts of both classes, scores all their windows, and follows the
gradient of the most toxic one; a text without words is among the clean ones. Word vectors start from the words'
smoothed log odds in that sample. Scoring covers every window of every row. Ids, labels, language and source are never
inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import sample_labels
from .shared import releasing
from .textio import LOWER_CODES, SPACE, chunks, mix, row_of, span_hashes, words

WORD_BITS, PAIR_BITS, WIDTH, HIDDEN = 15, 10, 8, 8
WINDOW, STRIDE, LONG, SLICE = 32, 16, 64, 2048
_MARKS = b".,;:!?\"'()[]*#$%&|-"
_INKED = np.zeros(256, bool)
_INKED[[b for b in range(256) if b not in _MARKS]] = True
_INKED &= ~SPACE


@dataclass
class Words:
    """The words of texts. ids: bucket of each word's hash, without marks at its ends; back: its place among the distinct
    words, of which each has ``entries`` pair buckets (flat in ``pairs``, with ``times`` each) and ``total`` pairs."""

    ids: np.ndarray
    back: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    entries: np.ndarray
    total: np.ndarray

    @classmethod
    def joined(cls, some: list[Words]) -> Words:
        before = np.cumsum([0, *(len(w.total) for w in some)])
        whole = lambda name: np.concatenate([getattr(w, name) for w in some])
        return cls(whole("ids"), np.concatenate([w.back + n for w, n in zip(some, before, strict=False)]), *map(whole, ("pairs", "times", "entries", "total")))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words, and their number in each row."""
    start, end, counts = words(data, offsets)
    inked = np.flatnonzero(_INKED[data])
    a, b = np.searchsorted(inked, start), np.searchsorted(inked, end)
    bare = a == b
    if len(inked):
        s = np.where(bare, start, inked[np.minimum(a, len(inked) - 1)])
        e = np.where(bare, end, inked[np.maximum(b - 1, 0)] + 1)
    else:
        s, e = start, end
    hashes = span_hashes(data, s, e, LOWER_CODES)
    ids = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    return Words(ids, back, *_pairs(data, s[at], e[at])), counts


def _pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each span the buckets of its neighbouring byte pairs, edges included, and how often each counts; their number
    and that of all pairs."""
    n = end - start + 1
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low = np.append(data, np.uint8(0)).astype(np.int64)
    low += 32 * ((low >= 65) & (low <= 90))
    left = np.where(at > np.repeat(start, n), low[at - 1], 0)
    right = np.where(at < np.repeat(end, n), low[at], 1)
    pairs = (mix((left * 257 + right).astype(np.uint64), 31) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    times, entries = np.ones(len(pairs), np.float32), n
    if (n > LONG).any():
        row = row_of(n)
        far = n[row] > LONG
        counted, again = np.unique(row[far] << PAIR_BITS | pairs[far], return_counts=True)
        rows = np.concatenate([row[~far], counted >> PAIR_BITS])
        order = np.argsort(rows, kind="stable")
        pairs = np.concatenate([pairs[~far], counted & ((1 << PAIR_BITS) - 1)])[order]
        times = np.concatenate([times[~far], again.astype(np.float32)])[order]
        entries = np.bincount(rows, minlength=len(n))
    return pairs, times, entries, n


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, and number per row of the windows; a row without words has one, without words."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    row = row_of(n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(counts) - counts, n) + k * STRIDE
    return begin, np.minimum(WINDOW, counts[row] - k * STRIDE), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Model:
    """p: parameters by name. Per direction d: Wx_d (WIDTH x 3 HIDDEN), Wh_d, b_d; gates in the order update, reset, new."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        p = {"word": normal(0.05, 1 << WORD_BITS, WIDTH), "pair": normal(0.05, 1 << PAIR_BITS, WIDTH)}
        for d in "fb":
            p |= {f"Wx_{d}": normal(0.4, WIDTH, 3 * HIDDEN), f"Wh_{d}": normal(0.3, HIDDEN, 3 * HIDDEN), f"b_{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(p | {"att": normal(0.3, 2 * HIDDEN), "out": normal(0.3, 2 * HIDDEN), "bias": np.zeros(1, np.float32)})

    def inputs(self, w: Words) -> np.ndarray:
        if not len(w.ids):
            return np.zeros((0, WIDTH), np.float32)
        chars = np.add.reduceat(self.p["pair"][w.pairs] * w.times[:, None], np.cumsum(w.entries) - w.entries, axis=0) / w.total[:, None].astype(np.float32)
        return self.p["word"][w.ids] + chars[w.back]

    def odds(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Score (log odds) of each window, SLICE of them at a time."""
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(x, begin[k : k + SLICE], size[k : k + SLICE]) for k in range(0, len(begin), SLICE))])

    def forward(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray, keep: bool = False):
        """Score (log odds) of each window; with ``keep`` also what back-propagation needs."""
        n, steps = len(begin), int(size.max(initial=0))
        at = begin[:, None] + np.arange(steps)
        inside = np.arange(steps) < size[:, None]
        at = np.where(inside, at, 0)
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        memory = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            wx = x @ self.p[f"Wx_{d}"] + self.p[f"b_{d}"] if len(x) else np.zeros((1, 3 * HIDDEN), np.float32)
            wh, h = self.p[f"Wh_{d}"], np.zeros((n, HIDDEN), np.float32)
            part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for t in order:
                g = wx[at[:, t]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ wh[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ wh[:, 2 * HIDDEN :])
                on = inside[:, t, None]
                if keep:
                    memory[d, t] = (h, z, r, new, on)
                h = np.where(on, h + z * (new - h), h)
                states[t, :, part] = h
        scores = states @ self.p["att"]
        scores = np.where(inside.T, scores, np.float32(-1e9))
        weight = np.exp(scores - scores.max(axis=0, initial=-1e9)) * inside.T
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pool = np.einsum("tn,tnh->nh", weight, states)
        odds = pool @ self.p["out"] + self.p["bias"][0]
        return (odds, (at, inside, states, weight, pool, memory)) if keep else odds

    def backward(self, x: np.ndarray, kept, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the parameters, and the inputs' (position, gradient) pairs. error: of each window's log odds."""
        at, inside, states, weight, pool, memory = kept
        steps, n = weight.shape
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "pair")}
        g["out"], g["bias"] = pool.T @ error, np.array([error.sum()], np.float32)
        to_pool = error[:, None] * self.p["out"]
        to_weight = np.einsum("nh,tnh->tn", to_pool, states)
        to_score = weight * (to_weight - (weight * to_weight).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", to_score, states)
        to_state = weight[:, :, None] * to_pool + to_score[:, :, None] * self.p["att"]
        to_x = np.zeros((steps, n, WIDTH), np.float32)
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            wx, wh = self.p[f"Wx_{d}"], self.p[f"Wh_{d}"]
            part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            carry = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                h, z, r, new, on = memory[d, t]
                dh = carry + to_state[t, :, part]
                dn = dh * z * (1 - new * new)
                dz = dh * (new - h) * z * (1 - z)
                drh = dn @ wh[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                gate = np.hstack([dz, dr, dn]) * on
                carry = np.where(on, dh * (1 - z) + drh * r + gate[:, : 2 * HIDDEN] @ wh[:, : 2 * HIDDEN].T, dh)
                g[f"b_{d}"] += gate.sum(axis=0)
                g[f"Wh_{d}"][:, : 2 * HIDDEN] += h.T @ gate[:, : 2 * HIDDEN]
                g[f"Wh_{d}"][:, 2 * HIDDEN :] += (r * h).T @ gate[:, 2 * HIDDEN :]
                g[f"Wx_{d}"] += x[at[:, t]].T @ gate
                to_x[t] += gate @ wx.T
        return g, at.T, inside.T, to_x

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        own, counts = words_of(data, offsets)
        begin, size, n = windows(counts)
        odds = self.odds(self.inputs(own), begin, size)
        best = np.maximum.reduceat(odds, np.cumsum(n) - n) if len(n) else odds
        return 1 / (1 + np.exp(-np.clip(best.astype(np.float64), -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 400, each: int = 8, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam on the log loss of each text's most toxic window; each step takes ``each`` texts of either class."""
    rng = np.random.default_rng(seed)
    m = Model.fresh()
    toxic, clean = np.flatnonzero(labels > 0.5), np.flatnonzero(labels <= 0.5)
    if not len(toxic) or not len(clean):
        m.p["bias"][:] = 3.0 if len(toxic) else -3.0
        return m
    data = []
    seen = np.zeros((2, 1 << WORD_BITS))
    for t, y in zip([*texts, b""], [*labels, 0.0], strict=True):
        own, counts = words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        data.append((own, *windows(counts)[:2]))
        if t:
            seen[int(y > 0.5), np.unique(own.ids)] += 1
    labels = np.append(labels, 0.0)
    share = (seen + 0.5) / (np.array([[len(clean)], [len(toxic)]]) + 1)
    m.p["word"][:, 0] = np.clip(np.log(share[1] / share[0]), -4, 4) / 4 * (seen.sum(axis=0) >= 3)
    first, second = {k: np.zeros_like(v) for k, v in m.p.items()}, {k: np.zeros_like(v) for k, v in m.p.items()}
    prior = np.log(len(toxic) / len(clean))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(toxic, each), rng.choice(clean, 2 * each), [len(data) - 1]])
        some = [data[i] for i in pick]
        own, n = Words.joined([w for w, _, _ in some]), np.array([len(b) for _, b, _ in some])
        before = np.cumsum([0, *(len(w.ids) for w, _, _ in some)])
        begin, size = np.concatenate([b + k for (_, b, _), k in zip(some, before, strict=False)]), np.concatenate([s for _, _, s in some])
        x = m.inputs(own)
        odds = m.odds(x, begin, size)
        best = np.array([a + int(np.argmax(odds[a : a + c])) for a, c in zip(np.cumsum(n) - n, n, strict=True)])
        y = (labels[pick] > 0.5).astype(np.float32)
        odds, kept = m.forward(x, begin[best], size[best], keep=True)
        error = ((_sigmoid(odds.astype(np.float32)) - y) / len(pick)).astype(np.float32)
        g, at, inside, to_x = m.backward(x, kept, error)
        flat, where = to_x[inside], at[inside]
        g["word"] = (own.ids[where], flat)
        word = own.back[where]
        counts = own.entries[word]
        pos = np.repeat(np.cumsum(own.entries)[word] - counts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        g["pair"] = (own.pairs[pos], np.repeat(flat / own.total[word][:, None], counts, axis=0) * own.times[pos, None])
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            if isinstance(v, tuple):
                touched, inv = np.unique(v[0], return_inverse=True)
                v = np.column_stack([np.bincount(inv, v[1][:, j]) for j in range(WIDTH)]).astype(np.float32)
                where_k: object = touched
            else:
                where_k = slice(None)
            first[k][where_k] = 0.9 * first[k][where_k] + 0.1 * v
            second[k][where_k] = 0.99 * second[k][where_k] + 0.01 * v * v
            m.p[k][where_k] -= slow * first[k][where_k] / (np.sqrt(second[k][where_k]) + 1e-6)
    m.p["bias"][0] += (prior + np.log(2.0)) / 2  # half way from the classes' shares in a step to those in the sample
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 4000, most_bytes: int = 40_000_000) -> Model:
    """Fit on the whole texts of at most ``sample`` labelled ids, fewer if these pass ``most_bytes`` together."""
    some = F.broadcast(sample_labels(labels, label, sample))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(some, "doc_id")
    once = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x"))
    texts, got, size = [], [], 0
    for r in once.select("doc_id", "x.label", "x.text").sort(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        own = r.text.encode()
        if size + len(own) > most_bytes:  # shorter ones may still fit
            continue
        size += len(own)
        texts.append(own)
        got.append(r.label)
    return fit(texts, np.array(got, np.float64))


def score_column(text: Column, model: Model, spark) -> Column:
    """The score of each text, 0 to 1: that of its most toxic window."""
    shipped = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = [shipped.value.score(data, offsets) for _, _, data, offsets in chunks(b, 1 << 18)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(releasing(scored), "double")(text)
