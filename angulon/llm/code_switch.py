"""Language identification of code-switched text: a linear-chain conditional random field over words.

Words are runs of letters A-Z (in lower case) and of bytes beyond ASCII. A word's features are its affixes (first and
last 1 to 3 bytes), the hashed n-grams of 2 to 4 bytes of the word between marks, and, where it is in the lexicon, in
which of BUCKETS steps its share of each language's uses lies. A word's score for a language is the sum of the mean weight
of each kind of feature; words in turn are tied by a learned matrix of transitions. Forward-backward gives each word's
chances of each language; a text's prediction is the language with the largest mean, the score that mean.

Forward-backward runs over blocks of BLOCK words at once: each block's product of transition matrices, then vectors from
block to block within each text, then the words of all blocks in step. So a text of any length takes few passes.

The lexicon is counted by Spark over all training texts: the LEXICON words with the largest sum of relative frequencies in
the languages, by steps of a 16th of a power of 2 (within the last step by hash), with counts of all of them. Weights and transitions are fitted on a bounded sample: of about
``sample`` texts, as many of each language, PIECES pieces of PIECE words each from anywhere in the text. Half of the
training sequences are single pieces, half are joined from pieces of several languages, which teaches the transitions.

Texts that are null or without a letter are ``und`` with score 0, as all are where nothing can be learnt. Equal chances
go to the language that sorts first. Equal texts have equal results. Labels that are null are not learnt. Empty tables
give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, releasing, stored
from .textio import CODES, LOWER_CODES, chunks, mix, row_of, runs, span_hashes, sums_by_row

BITS, LEXICON, BUCKETS, BLOCK, PIECE, PIECES, CHUNK, STEPS = 15, 20_000, 6, 64, 24, 4, 1 << 19, 16
NONE = "und"
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of features: affixes, n-grams, lexicon.
KINDS = 3


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(_INSIDE[data], offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(data, start, end, LOWER_CODES)


@dataclass
class Lexicon:
    """Words by rising hash, and of each the step of its share of each language."""

    keys: np.ndarray
    steps: np.ndarray

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes it has, and their places."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        return (self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)), at


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, value of each, and number for each word. Values of a kind of features of a word add up to 1."""
    size = end - start
    # the words between marks, one after another
    marked = np.full(int(size.sum() + 2 * len(size)), 0x5E, np.uint8)
    first = np.cumsum(size + 2) - size - 2
    marked[np.repeat(first + 1, size) + _places(size)] = _LOWER[data[np.repeat(start, size) + _places(size)]]
    word, ids, kinds = [], [], []

    def add(rows: np.ndarray, keys: np.ndarray, kind: int, salt: int) -> None:
        word.append(rows)
        ids.append((mix(keys, salt) >> np.uint64(64 - BITS)).astype(np.int64))
        kinds.append(np.full(len(rows), kind, np.int64))

    every = np.arange(len(size))
    for k in (1, 2, 3):
        long = every[size >= k]
        lo = first[long] + 1
        add(long, span_hashes(marked, lo, lo + k, CODES), 0, 10 + k)
        add(long, span_hashes(marked, lo + size[long] - k, lo + size[long], CODES), 0, 20 + k)
    for k in (2, 3, 4):
        n = np.maximum(size + 3 - k, 0)
        lo = np.repeat(first, n) + _places(n)
        add(np.repeat(every, n), span_hashes(marked, lo, lo + k, CODES), 1, 30 + k)
    known, at = lexicon.of(hashes)
    languages = lexicon.steps.shape[1]
    word.append(np.repeat(every[known], languages))
    ids.append(((1 << BITS) + np.arange(languages) * BUCKETS + lexicon.steps[at[known]]).ravel())
    kinds.append(np.full(int(known.sum()) * languages, 2, np.int64))
    word, ids, kinds = (np.concatenate(x) for x in (word, ids, kinds))
    cell = word * KINDS + kinds
    value = (1.0 / np.maximum(np.bincount(cell, minlength=len(size) * KINDS), 1))[cell]
    order = np.argsort(word, kind="stable")
    return ids[order], value[order], np.bincount(word, minlength=len(size))


def _places(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


@dataclass
class Model:
    languages: list[str]
    lexicon: Lexicon
    weights: np.ndarray  # features x languages
    start: np.ndarray
    tied: np.ndarray  # from x to

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words, and the place of each word among them."""
        hashes, at, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        ids, value, n = features(data, start[at], end[at], hashes, self.lexicon)
        return sums_by_row(self.weights[ids] * value[:, None], n), back

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's chances of the languages, and the number of words of each text."""
        start, end, counts = words(data, offsets)
        if not len(start):
            return np.zeros((0, len(self.languages))), counts
        scores, back = self.word_scores(data, start, end)
        return marginals(scores[back], counts, self.start, self.tied), counts

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the place of its language, and its mean chance."""
        p, counts = self.chances(data, offsets)
        mean = sums_by_row(p, counts) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        return best, np.clip(mean[np.arange(len(best)), best], 0, 1)


def marginals(scores: np.ndarray, counts: np.ndarray, start: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Chances of each label at each item of sequences that follow each other, by forward-backward over blocks."""
    n_labels = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a, first = np.exp(tied - tied.max()), np.exp(start - start.max())
    blocks = -(-counts // BLOCK)
    n = int(blocks.sum())
    seq = row_of(blocks)
    begin = np.repeat(np.cumsum(counts) - counts, blocks) + _places(blocks) * BLOCK
    size = np.minimum(np.repeat(np.cumsum(counts), blocks) - begin, BLOCK)
    order = np.argsort(-size, kind="stable")  # blocks that still have items at step t come first
    begin, size, seq, head = begin[order], size[order], seq[order], (_places(blocks) == 0)[order]
    live = [int((size > t).sum()) for t in range(BLOCK)]
    # each block's product of matrices; at a sequence's first item only its own scores
    product = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
    for t, k in enumerate(live):
        if not k:
            break
        m = product[:k] @ a if t else np.where(head[:k, None, None], product[:k], product[:k] @ a)
        m *= e[begin[:k] + t][:, None, :]
        product[:k] = m / m.max(axis=(1, 2), keepdims=True)
    # vectors into each block from the left and from the right, block after block of all sequences
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    opening, before = np.cumsum(blocks) - blocks, np.empty((n, n_labels))
    after = np.ones((n, n_labels))
    now, by_length = np.tile(first / first.sum(), (len(counts), 1)), np.argsort(-blocks, kind="stable")
    for b in range(int(blocks.max(initial=0))):
        some = by_length[: int((blocks > b).sum())]
        here = at[opening[some] + b]
        before[here] = now[some]
        v = (now[some][:, None, :] @ product[here])[:, 0]
        now[some] = v / v.sum(axis=1, keepdims=True)
    now = np.ones((len(counts), n_labels))
    for b in range(int(blocks.max(initial=0)) - 1, -1, -1):
        some = by_length[: int((blocks > b).sum())]
        here = at[opening[some] + b]
        after[here] = now[some]
        v = (product[here] @ now[some][:, :, None])[:, :, 0]
        now[some] = v / v.sum(axis=1, keepdims=True)
    left = np.empty_like(e)
    v = before
    for t, k in enumerate(live):
        if not k:
            break
        v = v[:k]
        v = (v @ a if t else np.where(head[:k, None], v, v @ a)) * e[begin[:k] + t]
        v = v / v.sum(axis=1, keepdims=True)
        left[begin[:k] + t] = v
    right = np.empty_like(e)
    v = after.copy()
    for t in range(max([t for t, k in enumerate(live) if k], default=-1), -1, -1):
        k = live[t]
        right[begin[:k] + t] = v[:k]
        # the vector before item t; a block that starts at t passes nothing on
        u = (v[:k] * e[begin[:k] + t]) @ a.T
        v[:k] = u / u.sum(axis=1, keepdims=True)
    p = left * right
    return p / p.sum(axis=1, keepdims=True)


def gradient(scores: np.ndarray, truth: np.ndarray, start: np.ndarray, tied: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences of equal length (rows x items x labels): mean log-likelihood of the truth by item, and its gradient by
    scores, start and transitions."""
    rows, n, _ = scores.shape
    a = np.exp(tied)
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    left, right, scale = np.empty_like(e), np.ones_like(e), np.empty((rows, n))
    v = np.exp(start)[None] * e[:, 0]
    for t in range(n):
        if t:
            v = (left[:, t - 1] @ a) * e[:, t]
        scale[:, t] = v.sum(axis=1)
        left[:, t] = v / scale[:, t, None]
    for t in range(n - 2, -1, -1):
        right[:, t] = (right[:, t + 1] * e[:, t + 1]) @ a.T / scale[:, t + 1, None]
    p = left * right
    total = np.log(scale).sum() + scores.max(axis=2).sum()
    one = np.eye(scores.shape[2])[truth]
    value = (scores * one).sum() + start[truth[:, 0]].sum() + tied[truth[:, :-1], truth[:, 1:]].sum() - total
    pair = np.einsum("rti,ij,rtj->ij", left[:, :-1], a, right[:, 1:] * e[:, 1:] / scale[:, 1:, None])
    seen = np.einsum("rti,rtj->ij", one[:, :-1], one[:, 1:])
    per = rows * n
    return value / per, (one - p) / per, (one[:, 0] - p[:, 0]).sum(axis=0) / per, (seen - pair) / per


def fit(texts: list[bytes], labels: np.ndarray, languages: list[str], lexicon: Lexicon, steps: int = 400, batch: int = 48, rate: float = 0.3, ridge: float = 1e-5, seed: int = 5) -> Model:
    """Gradient ascent (Adagrad) on the likelihood of sequences made of the pieces (texts of PIECE words at most)."""
    rng, n = np.random.default_rng(seed), len(languages)
    m = Model(languages, lexicon, np.zeros(((1 << BITS) + n * BUCKETS, n)), np.zeros(n), np.zeros((n, n)))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end, counts = words(data, offsets)
    if n < 2 or not len(start):
        return m
    hashes, at, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    ids, value, size = features(data, start[at], end[at], hashes, lexicon)
    ends = np.concatenate([[0], np.cumsum(size)])
    of = [np.flatnonzero((labels == k) & (counts > 0)) for k in range(n)]
    of = [x for x in of if len(x)]
    opening = np.cumsum(counts) - counts
    seen = [np.full_like(x, 1e-8) for x in (m.weights, m.start, m.tied)]

    def sequence() -> tuple[np.ndarray, np.ndarray]:
        """PIECE words: of one language, or of several in turn."""
        word, truth = [], []
        switched, kept = rng.random() < 0.5, of[rng.integers(len(of))]
        while len(word) < PIECE:
            piece = rng.choice(of[rng.integers(len(of))] if switched else kept)
            length = int(rng.integers(1, PIECE)) if switched else PIECE
            lo = int(rng.integers(max(1, counts[piece] - length + 1)))
            some = back[opening[piece] + lo : opening[piece] + min(lo + length, counts[piece])]
            word.extend(some)
            truth.extend([labels[piece]] * len(some))
        return np.array(word[:PIECE]), np.array(truth[:PIECE])

    for step in range(steps):
        made = [sequence() for _ in range(batch)]
        word, truth = np.stack([w for w, _ in made]), np.stack([t for _, t in made])
        some, where = np.unique(word, return_inverse=True)
        entry = np.repeat(ends[some], size[some]) + _places(size[some])
        f, x, row = ids[entry], value[entry], row_of(size[some])
        scores = sums_by_row(m.weights[f] * x[:, None], size[some])
        _, g, g_start, g_tied = gradient(scores[where.reshape(word.shape)], truth, m.start, m.tied)
        by_word = np.column_stack([np.bincount(where.ravel(), g[:, :, k].ravel(), len(some)) for k in range(n)])
        touched, inv = np.unique(f, return_inverse=True)
        g = np.column_stack([np.bincount(inv, by_word[row, k] * x, len(touched)) for k in range(n)]) - ridge * m.weights[touched]
        seen[0][touched] += g * g
        m.weights[touched] += rate * g / np.sqrt(seen[0][touched])
        slow = rate / 3 * (1 - step / steps)
        for v, d, s in ((m.start, g_start, seen[1]), (m.tied, g_tied, seen[2])):
            s += d * d
            v += slow * d / np.sqrt(s)
    return m


def least_hashes(some: int, size: int) -> int:
    """The signed 64-bit hash up to which about ``some`` of ``size`` hashes lie; the greatest there is, where that is all."""
    return min(-(1 << 63) + (some << 64) // max(size, 1), (1 << 63) - 1)


def lexicon_of(docs: DataFrame, languages: list[str], sizes: dict[str, int]) -> Lexicon:
    """Counted over all texts of ``docs`` (text, lang); sizes: texts of each language."""
    n = len(languages)
    at = {v: k for k, v in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            h, code, times = np.concatenate(keys), np.concatenate(codes), np.concatenate(tallies)
            order = np.lexsort((code, h))
            h, code, times = h[order], code[order], times[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(code[first]), pa.array(np.add.reduceat(times, first))], ["h", "code", "n"])

        keys, codes, tallies, held = [], [], [], 0
        for b in batches:
            lang = np.array([at[v] for v in b.column("lang").to_pylist()], np.int64)
            for lo, hi, data, offsets in chunks(b.column("text"), CHUNK):
                start, end, counts = words(data, offsets)
                if not len(start):
                    continue
                distinct, back = np.unique(word_hashes(data, start, end), return_inverse=True)
                cell, times = np.unique(back * n + lang[lo:hi][row_of(counts)], return_counts=True)
                keys.append(distinct[cell // n])
                codes.append(cell % n)
                tallies.append(times)
                held += len(cell)
                if held > 1 << 21:  # bounded memory: what is there goes out, Spark adds up
                    yield table()
                    keys, codes, tallies, held = [], [], [], 0
        if held:
            yield table()

    counts = docs.mapInArrow(releasing(counted), "h bigint, code bigint, n bigint").groupBy("h").agg(*[F.sum(F.when(F.col("code") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(n)])
    share = sum((F.col(f"c{k}") / F.lit(float(sizes[languages[k]])) for k in range(1, n)), F.col("c0") / F.lit(float(sizes[languages[0]])))
    counts = stored(counts.withColumn("share", share).withColumn("step", F.floor(F.log2("share") * STEPS)), "words")
    # steps of the share from the top down until they hold enough words: what is above the last step reaches the driver
    held, lowest = 0, None
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):  # STEPS rows a power of 2
        held, lowest = held + r.n, r.step
        if held >= LEXICON:
            break
    rows = counts.where(F.col("step") > lowest).collect() if lowest is not None else []
    last = counts.where(F.col("step") == lowest) if lowest is not None else counts.limit(0)
    # of the last step itself only as many by hash as are wanting, found within ranges of the hash
    wanting = LEXICON - len(rows)
    size = last.count()
    if size > 2 * wanting:
        last = last.where(F.col("h") <= least_hashes(2 * (wanting + 100), size))
    rows += last.orderBy("h").limit(wanting).collect()
    discard(counts)
    if not rows:
        return Lexicon(np.zeros(0, np.uint64), np.zeros((0, n), np.int64))
    keys = np.array([r.h for r in rows], np.int64).view(np.uint64)
    each = np.array([[r[f"c{k}"] / sizes[v] for k, v in enumerate(languages)] for r in rows])
    steps = np.minimum(np.sqrt(each / each.sum(axis=1, keepdims=True)) * BUCKETS, BUCKETS - 1).astype(np.int64)
    order = np.argsort(keys)
    return Lexicon(keys[order], steps[order])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, piece: up to PIECES pieces of each text, from places that its hash gives."""
    for b in batches:
        for lo, hi, data, offsets in chunks(b.column("text"), CHUNK):
            start, end, counts = words(data, offsets)
            row = np.repeat(np.arange(hi - lo), np.where(counts, PIECES, 0))
            seeds = mix(b.column("h").slice(lo, hi - lo).to_numpy().view(np.uint64)[row] + _places(np.where(counts, PIECES, 0)).astype(np.uint64), 3)
            first = (seeds % np.maximum(counts[row] - PIECE + 1, 1).astype(np.uint64)).astype(np.int64)
            opening = (np.cumsum(counts) - counts)[row]
            last = np.minimum(first + PIECE, counts[row]) - 1
            texts = [data[s:e].tobytes() for s, e in zip(start[opening + first], end[opening + last], strict=True)] if len(row) else []
            yield pa.RecordBatch.from_arrays([b.column("lang").slice(lo, hi - lo).take(pa.array(row)), pa.array(texts, pa.binary())], ["lang", "piece"])


def train(docs: DataFrame, sample: int = 2000) -> Model | None:
    """From the text and lang of ``docs``, where both are there. None where there is no such row."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return None
    lexicon = lexicon_of(known, languages, sizes)
    # a hash below a bound of its language, which leaves about as many texts of each
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 1.2 * sample / len(languages) / sizes[k]))])
    hashed = known.withColumn("h", F.xxhash64("text", "lang"))
    some = hashed.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * F.lit(float(1 << 30))).dropDuplicates(["h"])
    drawn = stored(some.orderBy("h").limit(2 * sample).mapInArrow(releasing(_pieces), "lang string, piece binary"), "pieces")
    rows = drawn.orderBy("lang", "piece").collect()  # 2 * sample * PIECES pieces of PIECE words at most
    discard(drawn)
    at = {v: k for k, v in enumerate(languages)}
    return fit([bytes(r.piece) for r in rows], np.array([at[r.lang] for r in rows], np.int64), languages, lexicon)


def _shipped(model: Model, spark):
    return spark.sparkContext.broadcast(model)


def predict_columns(text: Column, model: Model | None, spark) -> tuple[Column, Column]:
    """lang_pred and score of each text."""
    if model is None:
        return F.lit(NONE), F.lit(0.0)
    shipped = _shipped(model, spark)

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(shipped.value.languages, object)
        for b in batches:
            done = [shipped.value.predict(data, offsets) for _, _, data, offsets in chunks(b, CHUNK)]
            best, score = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, int) for k in (0, 1))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    predicted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(releasing(predicted), "lang string, score double")(text)
    lettered = F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))
    return F.when(lettered, found["lang"]).otherwise(NONE), F.when(lettered, found["score"]).otherwise(0.0)


def spans_column(text: Column, model: Model, spark) -> Column:
    """The stretches of words with one most likely language each: array of (lang, first_word, n_words, score)."""
    shipped = _shipped(model, spark)

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(shipped.value.languages, object)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            out = []
            for _, _, data, offsets in chunks(b, CHUNK):
                p, counts = shipped.value.chances(data, offsets)
                for lo, n in zip(np.cumsum(counts) - counts, counts, strict=True):
                    best = p[lo : lo + n].argmax(axis=1)
                    cut = np.flatnonzero(np.r_[n > 0, np.diff(best) != 0])
                    out.append([{"lang": names[best[i]], "first_word": i, "n_words": j - i, "score": float(p[lo + i : lo + j, best[i]].mean())} for i, j in zip(cut, np.r_[cut[1:], n], strict=True)] if n else [])
            yield pa.array(out, kind)

    spans.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(releasing(spans), "array<struct<lang: string, first_word: int, n_words: int, score: double>>")(text)
