"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are runs of bytes other than white space, A-Z in lower case, and one end after each text. A token's class comes
from its last two bytes (the end is class 0), its group within the class from its first two, so unseen words have both.
The model is

    P(token | before) = P(class | before) * P(group | class, before) * (count + 1) / (tokens + words of the cell + 1)

where a cell is a class and a group of it. Both P are softmaxes, over WAYS classes and over WAYS groups, of a bias and
three hashed features: the token before, the one before that alone (skip) and both together; for groups, bias and
features are the class's own. In each cell all unseen words are one event, so the probabilities of known words and of
the cells' unseen words sum to 1.

Training: words are counted over all training texts; the features' weights start from damped pointwise information.
Biases and weights are then moved by UPDATES distributed gradient updates, each a pass over all training texts: tasks
sum the expected counts of every feature and outcome under the present weights, and observed less expected counts, over
their number (the gradient in the scale of its feature), is added, a third of it for each of the three features. Tables
of weights have a fixed size; tasks' tables are summed in a tree. The table of word counts grows with the texts.

Scoring: the HEAD most frequent words' counts are broadcast; the other words of a text, by hash, are joined to the
whole table of counts. Words are told apart by 56 hash bits besides their cell, rows by a 64-bit hash of id and text;
rows with equal id and text get equal results. Null and empty texts are the end alone; texts may be of any length; ids
may be null; other columns play no part. Without training texts every word is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import releasing, stored
from .textio import LOWER_CODES, chunks, mix, row_of, span_hashes, sums_by_row, words

WAYS, ROW_BITS, HEAD, UPDATES, WIDE, NARROW = 16, 15, 1 << 18, 3, 1 << 15, 1 << 13
#: Bytes of text that become tokens at once under given weights, about WIDE tokens: their arrays fit the cache.
CHUNK = 3 << 16
CELLS = WAYS * WAYS
ROWS, BLOCK_ROWS, FAN_IN = 1 << ROW_BITS, 512, 32
_END, _START = np.uint64(0), mix(np.array([1], np.uint64), 41)[0]
_DAMPING = np.array([0.6, 0.4, 0.3])
#: Pseudo-counts, by the outcomes' shares, of a feature when weights are begun and when they are moved.
_BEGUN, _MOVED = 40.0, 100.0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of each row, the end included, and their number. A key's low bits are the cell: class, group."""
    start, end, counts = words(data, offsets)
    hashes = span_hashes(data, start, end, LOWER_CODES)
    low = data.astype(np.int64)
    low += 32 * ((low >= 65) & (low <= 90))
    two = end - start > 1
    edge = lambda near, far: mix((near * 256 + np.where(two, far, 0)).astype(np.uint64), 42)
    if len(start):
        kind = np.uint64(WAYS) * (np.uint64(1) + edge(low[end - 1], low[end - 2]) % np.uint64(WAYS - 1)) + (edge(low[start], low[np.minimum(start + 1, len(low) - 1)]) >> np.uint64(60))
    else:
        kind = hashes
    keys = np.full(len(hashes) + len(counts), _END, np.uint64)
    ends = np.cumsum(counts + 1) - 1
    is_word = np.ones(len(keys), bool)
    is_word[ends] = False
    keys[is_word] = (hashes & ~np.uint64(CELLS - 1)) | kind
    return keys, counts + 1


def outcomes(keys: np.ndarray) -> list[np.ndarray]:
    """Class and group of each token."""
    cell = (keys & np.uint64(CELLS - 1)).astype(np.int64)
    return [cell // WAYS, cell % WAYS]


def features(keys: np.ndarray, counts: np.ndarray) -> list[list[np.ndarray]]:
    """For each of the two factors: the row of the bias and of weights of each of a token's three features."""
    one, two = np.empty_like(keys), np.empty_like(keys)
    one[1:], two[2:] = keys[:-1], keys[:-2]
    first = np.cumsum(counts) - counts
    one[first] = _START
    two[first] = _START
    second = first[counts > 1] + 1
    two[second] = _START
    kind = outcomes(keys)[0]
    out = []
    for own in (np.zeros_like(kind), kind):
        turn = own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a, b, c = mix(one + turn, 43), mix(two + turn, 44), mix(one * np.uint64(3) + two + turn, 45)
        out.append([own, (a >> np.uint64(66 - ROW_BITS)).astype(np.int64), (ROWS >> 2) + (b >> np.uint64(66 - ROW_BITS)).astype(np.int64), (ROWS >> 1) + (c >> np.uint64(65 - ROW_BITS)).astype(np.int64)])
    return out


#: Rows of the features' counts, then of the biases'. Where each of the three features' rows begin, and their end.
WHOLE = ROWS + WAYS
_FROM = (0, ROWS >> 2, ROWS >> 1, ROWS)


@dataclass
class Weights:
    """Of each factor WHOLE x WAYS weights, the biases last."""

    tables: list[np.ndarray]

    def exponentials(self, factor: int, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """exp of the log odds of each outcome, and their sum."""
        w = self.tables[factor]
        # Rows are always within the table; "clip" spares the copy that a check of them needs.
        odds = np.take(w[ROWS:], rows[0], axis=0, mode="clip")
        more = np.empty_like(odds)
        for r in rows[1:]:
            odds += np.take(w, r, axis=0, out=more, mode="clip")
        e = np.exp(odds, out=odds)
        return e, np.einsum("ij->i", e)

    def log10_cell(self, keys: np.ndarray, rows: list[list[np.ndarray]]) -> np.ndarray:
        out = np.zeros(len(keys))
        kinds = outcomes(keys)
        for k in range(0, len(keys), NARROW):
            for factor in range(2):
                e, total = self.exponentials(factor, [r[k : k + NARROW] for r in rows[factor]])
                out[k : k + NARROW] += np.log10(e[np.arange(len(e)), kinds[factor][k : k + NARROW]] / total)
        return out


def _share(observed: np.ndarray) -> np.ndarray:
    """Each row's prior shares of the outcomes (of all texts; a bias row's own), from the biases' counts."""
    bias = observed[ROWS:] + 1.0
    every = bias.sum(axis=0) - (WAYS - 1)
    return np.vstack([np.broadcast_to(every / every.sum(), (ROWS, WAYS)), bias / bias.sum(axis=1, keepdims=True)])


def initial(observed: list[np.ndarray]) -> Weights:
    """Weights from the observed counts: biases are the log shares, features' weights damped log ratios to these."""
    out = []
    for seen in observed:
        share = _share(seen)
        ratio = np.log((seen + _BEGUN * share) / ((seen.sum(axis=1, keepdims=True) + _BEGUN) * share))
        ratio[:ROWS] *= np.repeat(_DAMPING, [ROWS >> 2, ROWS >> 2, ROWS >> 1])[:, None]
        ratio[ROWS:] = np.log(share[ROWS:])
        out.append(np.clip(ratio, -14, 14).astype(np.float32))
    return Weights(out)


def updated(w: Weights, observed: list[np.ndarray], expected: list[np.ndarray]) -> Weights:
    """A gradient step of every bias and weight, in the scale of its expected count."""
    step = lambda seen, due: (seen - due) / (np.maximum(seen, due) + _MOVED * _share(seen)) / 3
    return Weights([np.clip(t + step(seen, due), -14, 14).astype(np.float32) for t, seen, due in zip(w.tables, observed, expected, strict=True)])


def _observe(tables: list[np.ndarray], keys: np.ndarray, rows: list[list[np.ndarray]]) -> None:
    for table, kind, own in zip(tables, outcomes(keys), rows, strict=True):
        table += np.bincount(np.concatenate([(own[0] + ROWS) * WAYS + kind, *(r * WAYS + kind for r in own[1:])]), minlength=table.size).reshape(table.shape)


def _expect(tables: list[np.ndarray], w: Weights, rows: list[list[np.ndarray]]) -> None:
    """Adds the expected counts to tables of WAYS x WHOLE."""
    for factor, table in enumerate(tables):
        for k in range(0, len(rows[factor][0]), WIDE):
            some = [r[k : k + WIDE] for r in rows[factor]]
            share = np.empty((WAYS, len(some[0])))
            for j in range(0, len(some[0]), NARROW):
                e, total = w.exponentials(factor, [r[j : j + NARROW] for r in some])
                np.divide(e.T, total, out=share[:, j : j + NARROW])
            parts = [(r - lo, lo, hi) for r, lo, hi in zip(some[1:], _FROM[:-1], _FROM[1:], strict=True)]
            for c in range(WAYS):
                table[c, ROWS:] += np.bincount(some[0], share[c], minlength=WAYS)
                for r, lo, hi in parts:
                    table[c, lo:hi] += np.bincount(r, share[c], minlength=hi - lo)


_TABLES = "block int, part int, sums binary"


def _tables(shipped):
    """Each task's tables of observed (without weights) or expected counts, in blocks of rows."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = [np.zeros((WHOLE, WAYS) if shipped is None else (WAYS, WHOLE)) for _ in range(2)]
        for b in batches:
            for _, _, data, offsets in chunks(b.column("text"), 1 << 20 if shipped is None else CHUNK):
                keys, counts = tokens(data, offsets)
                rows = features(keys, counts)
                if shipped is None:
                    _observe(made, keys, rows)
                else:
                    _expect(made, shipped.value, rows)
        whole = np.vstack(made if shipped is None else [t.T for t in made])
        blocks = [(k // BLOCK_ROWS, np.ascontiguousarray(whole[k : k + BLOCK_ROWS], np.float32).tobytes()) for k in range(0, len(whole), BLOCK_ROWS)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([x[1] for x in blocks], pa.binary())], ["block", "part", "sums"])

    return releasing(tables)


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["sums"])
    return pa.table({"block": table["block"].slice(0, 1), "part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def summed(texts: DataFrame, shipped=None) -> list[np.ndarray]:
    """The sums of the tasks' tables: at most FAN_IN blocks of 32 KB meet in a group, however many tasks there are."""
    parts = texts.rdd.getNumPartitions()
    blocks = texts.mapInArrow(_tables(shipped), _TABLES)
    while True:
        blocks = blocks.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInArrow(_add, _TABLES)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    whole = np.zeros((2 * WHOLE, WAYS))
    for r in blocks.collect():  # of the fixed size of the tables
        some = np.frombuffer(r.sums, np.float32).reshape(-1, WAYS)
        whole[r.block * BLOCK_ROWS : r.block * BLOCK_ROWS + len(some)] += some
    return [whole[:WHOLE], whole[WHOLE:]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    held, size = [], 0
    for b in batches:
        for _, _, data, offsets in chunks(b.column("text")):
            held.append(np.unique(tokens(data, offsets)[0], return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def kind_of(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(CELLS - 1)).cast("int")


@dataclass
class Model:
    weights: Weights
    head_keys: np.ndarray
    head_counts: np.ndarray
    n: int
    v: int
    log10_cell_total: np.ndarray


def train(texts: DataFrame, updates: int = UPDATES) -> tuple[Model, DataFrame]:
    """The model, and the table (key, n) of all words' counts."""
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(texts.mapInArrow(releasing(_counted), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "word_counts")
    by_class = counts.groupBy(kind_of("key").alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # CELLS rows at most
    totals = np.ones(CELLS)
    for r in by_class:
        totals[r.kind] += r.n + r.v
    head = counts.orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    keys, n = head["key"].to_numpy().view(np.uint64), head["n"].to_numpy()
    order = np.argsort(keys)
    observed = summed(texts)
    w = initial(observed)
    for _ in range(updates):
        w = updated(w, observed, summed(texts, texts.sparkSession.sparkContext.broadcast(w)))
    return Model(w, keys[order], n[order], sum(r.n for r in by_class), sum(r.v for r in by_class), np.log10(totals)), counts


_SCORED = "doc_id bigint, key bigint, n_tokens bigint, known bigint, counted double, classes double, tail array<bigint>, times array<int>"


def _scored(shipped):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shipped.value
        gain = np.log10(m.head_counts + 1.0)
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column("text"), CHUNK):
                keys, counts = tokens(data, offsets)
                part = m.weights.log10_cell(keys, features(keys, counts)) - m.log10_cell_total[(keys & np.uint64(CELLS - 1)).astype(np.int64)]
                at = np.minimum(np.searchsorted(m.head_keys, keys), max(len(m.head_keys) - 1, 0))
                hit = m.head_keys[at] == keys if len(m.head_keys) else np.zeros(len(keys), bool)
                row = row_of(counts)
                own = np.where(hit, gain[at], 0.0) if len(gain) else np.zeros(len(keys))
                rest = np.flatnonzero(~hit)
                order = rest[np.lexsort((keys[rest], row[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order))).astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[order][first], minlength=hi - lo))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, hi - lo),
                        b.column("key").slice(lo, hi - lo),
                        pa.array(counts.astype(np.int64)),
                        pa.array(np.bincount(row[hit], minlength=hi - lo).astype(np.int64)),
                        pa.array(sums_by_row(own, counts)),
                        pa.array(sums_by_row(part, counts)),
                        pa.ListArray.from_arrays(ends, pa.array(keys[order][first].view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(times)),
                    ],
                    ["doc_id", "key", "n_tokens", "known", "counted", "classes", "tail", "times"],
                )

    return scored


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigram) and score (the model's), log10, of each row."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    part = stored(rows.mapInArrow(releasing(_scored(shipped)), _SCORED), "scored")
    tail = part.select(F.col("key").alias("row"), F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("key"), F.col("x.times").alias("times"))
    found = tail.join(counts, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"))
    part = part.drop("tail", "times")
    same = part.groupBy("key").agg(F.count("*").alias("same"))
    both = part.join(found.join(same, found["row"] == same["key"]).select("row", "more", "gain", "same"), part["key"] == F.col("row"), "left")
    gained = F.col("counted") + F.coalesce(F.col("gain") / F.col("same"), F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("more") / F.col("same"), F.lit(0)).cast("bigint")).alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (gained - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1)))).alias("base_score"),
        (gained + F.col("classes")).alias("score"),
    )
