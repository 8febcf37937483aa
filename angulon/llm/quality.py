"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Each text is a sparse vector x: hashed words with their L2-normalised square-root counts, and for each of the
statistics in STATISTICS an indicator of the bin it falls in. The score is
``sigmoid(b + w.x + 1/2 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``: all pairwise interactions, in time
linear in the entries of x. Null and empty texts have no words and the lowest bin of each statistic; their score
is what the model gives that vector. Ids, labels, language and source are never inputs.

The model is fitted on a bounded sample (``sample`` labelled ids, lowest hash first; of several texts of an id that of
the lowest hash); scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import releasing
from .textio import LOWER_CODES, chunks, row_of, span_hashes, sums_by_row, words

WORD_BITS, BINS, FACTORS, CHUNK = 14, 12, 8, 1 << 18
#: Kinds of bytes whose shares are statistics: other, lower, upper, digit, blank, line end, .,;:, !?, other marks, beyond ASCII.
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"\"#$%&'()*+-/<=>@[\\]^_`{|}~", range(128, 256)], 1):
    _KIND[list(_bytes)] = _k
KINDS = 10
STATISTICS = KINDS + 4
WIDTH = (1 << WORD_BITS) + STATISTICS * BINS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, values and number of entries of each row."""
    rows = len(offsets) - 1
    start, end, counts = words(data, offsets)
    hashes = span_hashes(data, start, end, LOWER_CODES)
    keys = (row_of(counts) << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    keys, times = np.unique(keys, return_counts=True)
    row, value = keys >> WORD_BITS, np.sqrt(times.astype(np.float64))
    distinct = np.bincount(row, minlength=rows)
    value /= np.sqrt(np.maximum(counts, 1.0))[row]
    size = np.diff(offsets)
    kind = np.bincount(row_of(size) * KINDS + _KIND[data], minlength=rows * KINDS).reshape(rows, KINDS)
    share = kind / np.maximum(size, 1)[:, None]
    length = sums_by_row((end - start).astype(np.float64), counts) / np.maximum(counts, 1)
    more = np.column_stack([np.log1p(counts) / 12, distinct / np.maximum(counts, 1), length / 20, kind[:, 5] / np.maximum(counts, 1)])
    stats = np.sqrt(np.clip(np.hstack([share, more]), 0, 1))
    bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1) + np.arange(STATISTICS) * BINS + (1 << WORD_BITS)
    ids = np.concatenate([keys & ((1 << WORD_BITS) - 1), bins.ravel()])
    order = np.argsort(np.concatenate([row, np.repeat(np.arange(rows), STATISTICS)]), kind="stable")
    values = np.concatenate([value, np.full(bins.size, STATISTICS**-0.5)])
    return ids[order], values[order].astype(np.float32), distinct + STATISTICS


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, ids: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = self.factors[ids] * values[:, None]
        linear = sums_by_row(self.weights[ids] * values, counts)
        pairs = (sums_by_row(v, counts) ** 2 - sums_by_row(v * v, counts)).sum(axis=1) / 2
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.05, ridge: float = 1e-5, seed: int = 7) -> Model:
    """Minibatch gradient descent (Adagrad) on the log loss; both classes weigh as they occur."""
    rng = np.random.default_rng(seed)
    m = Model(0.0, np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, FACTORS)).astype(np.float32))
    if not len(rows):
        return m
    m.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    seen_w, seen_v, order = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), np.zeros(0, int)
    for _ in range(steps):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(rows))])
        pick, order = order[:batch], order[batch:]
        counts = np.array([len(rows[i][0]) for i in pick])
        ids, values = (np.concatenate([rows[i][j] for i in pick]) for j in (0, 1))
        v = m.factors[ids]
        sums = sums_by_row(v * values[:, None], counts)
        error = (m.score(ids, values, counts) - labels[pick]) / len(pick)
        row = row_of(counts)
        touched, at = np.unique(ids, return_inverse=True)
        g = np.bincount(at, error[row] * values) + ridge * m.weights[touched]
        seen_w[touched] += g * g
        m.weights[touched] -= rate * g / np.sqrt(seen_w[touched])
        each = error[row, None] * values[:, None] * (sums[row] - v * values[:, None])
        g = np.column_stack([np.bincount(at, each[:, f]) for f in range(FACTORS)]) + ridge * m.factors[touched]
        seen_v[touched] += g * g
        m.factors[touched] -= rate / 4 * g / np.sqrt(seen_v[touched])
        m.bias -= rate * float(error.sum())
    return m


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offsets in chunks(b.column("text"), CHUNK):
            ids, values, counts = features(data, offsets)
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("label").slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values))], ["label", "ids", "values"]
            )


def sample_labels(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids, lowest hash first. Null ids and labels are left out; of several labels of an id the highest counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000) -> Model:
    """Fit on the documents of at most ``sample`` labelled ids. Without any, every score is that of an even prior."""
    some = F.broadcast(sample_labels(labels, label, sample))
    # one row an id: its copies are reduced where they are read
    once = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x"))
    got = once.orderBy("doc_id").select("x.label", "x.text").mapInArrow(releasing(_featurise), "label double, ids array<int>, values array<float>").toArrow()
    rows = [(np.asarray(i.values.to_numpy()), np.asarray(v.values.to_numpy())) for i, v in zip(got["ids"], got["values"], strict=True)]
    return fit(rows, got["label"].to_numpy())


def score_column(text: Column, model: Model, spark) -> Column:
    """The score of each text, 0 to 1."""
    shipped = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = [shipped.value.score(*features(data, offsets)) for _, _, data, offsets in chunks(b, CHUNK)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(releasing(scored), "double")(text)
