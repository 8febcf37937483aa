"""MinHash near-duplicates that heed order: several minimum k-mers a sketch, kept in the order of the text.

A document is its sequence of shingles (K words; fewer words make one shingle), each labelled with its occurrence
number, so that labelled shingles are distinct. A sketch takes the L labelled shingles with the least hashes under its
seed and hashes these in the order of the text: two documents share it with the chance that they share, in the same
order, what is least, likeness to the power L; SKETCHES of them, any of which makes a candidate, miss a pair at
likeness 0.8 with a chance of 1e-4, one at 0.9 never to speak of. Candidates are verified by aligning their labelled shingles in order, within the band of diagonals that a similar
pair can use: with m aligned of n1 and n2, likeness m / (n1 + n2 - m) must be at least the threshold.

Words are runs of bytes other than white space, A-Z in lower case. Null and empty texts have no words and are copies of
each other. Rows with equal id and text are one document; texts are told apart by a 64-bit hash. Extra columns of the
input are ignored by ``classes_of`` and kept by ``keep_one``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .shared import discard, few, releasing, scratch, stored
from .textio import LOWER_CODES, chunks, mix, row_of, span_hashes, words

K, L, SKETCHES, THRESHOLD = 5, 6, 30, 0.8
#: Words of a document's odd sketch, and text for each part of the sketches' space.
WORDS, PART_BYTES = 32, 1 << 24
#: Short documents' sketches take fewer shingles; a pair whose sizes the threshold allows has one kind in common.
L_SHORT, SHORT = 2, (12, 14)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of K words of each row, in order, and their number; fewer words, at least one, make one run."""
    n = np.where(counts > 0, np.maximum(counts - K + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.repeat(np.cumsum(counts), n)
    out = np.zeros(len(first), np.uint64)
    for j in range(K):
        at = first + j
        here = at < last
        out = out * _TIMES + np.where(here, hashes[np.minimum(at, max(len(hashes) - 1, 0))], np.uint64(j)) if len(hashes) else out
    return mix(out), n


def labelled(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys made distinct within each row by their occurrence number."""
    row = row_of(counts)
    order = np.lexsort((keys, row))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    if not same.any():
        return keys
    place = np.arange(len(keys))
    times = np.empty(len(keys), np.uint64)
    times[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
    return np.where(times > 0, mix(keys + times * _TIMES), keys)


def _least(h: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """rows x size places of the least values of each row; rows with fewer have the largest integer for the rest."""
    none = np.iinfo(np.int64).max
    places = np.full((len(counts), size), none)
    todo = np.flatnonzero(counts)
    first = np.cumsum(counts) - counts
    room = 5.0 * size
    while len(todo):  # values below a bound that lets about 5 * size of a row pass; again with more room where that was too few
        n = counts[todo]
        bound = np.where(n <= room, 2.0**64, room / n * 2.0**64)
        at = np.repeat(first[todo], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) if len(todo) < len(counts) else np.arange(len(h))
        hit = np.flatnonzero(h[at] < np.repeat(np.minimum(bound, 2.0**64 - 4096).astype(np.uint64), n)) if (n > room).any() else np.arange(len(at))
        row = np.repeat(np.arange(len(todo)), n)[hit]
        order = np.lexsort((h[at[hit]], row))
        row, hit = row[order], at[hit[order]]
        found = np.bincount(row, minlength=len(todo))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
        keep = rank < size
        places[todo[row[keep]], rank[keep]] = hit[keep]
        short = (found < np.minimum(size, n)) & (n > room)
        todo, room = todo[short], room * 8
    return places


def sketches(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """rows x SKETCHES hashes (int64) of ``size`` labelled shingles each. Rows without shingles have the same sketches."""
    out = np.zeros((len(counts), SKETCHES), np.uint64)
    seeds = mix(np.arange(2 * SKETCHES, dtype=np.uint64), 11)
    for s in range(SKETCHES):
        h = (keys ^ seeds[s]) * (seeds[SKETCHES + s] | np.uint64(1))
        h ^= h >> np.uint64(29)
        places = _least(h, counts, size)
        places.sort(axis=1)  # the order of the text
        value = np.full(len(counts), s * 64 + size, np.uint64)
        for r in range(size):
            there = places[:, r] < len(keys)
            value = mix(value * _TIMES + (np.where(there, keys[np.minimum(places[:, r], len(keys) - 1)], np.uint64(7)) if len(keys) else np.uint64(7)))
        out[:, s] = value
    return out.view(np.int64)


def _placed(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes, how many sketches each has, and the sketches."""
    node = b.column("node").to_numpy()
    for lo, hi, data, offsets in chunks(b.column("text"), 1 << 18):
        start, end, counts = words(data, offsets)
        keys, n = shingles(span_hashes(data, start, end, LOWER_CODES), counts)
        keys = labelled(keys, n)
        of_many, of_few = n >= SHORT[0], n <= SHORT[1]
        both = np.zeros((2, hi - lo, SKETCHES), np.int64)
        for made, pick, size in ((both[0], of_many, L), (both[1], of_few, L_SHORT)):
            made[pick] = sketches(keys[np.repeat(pick, n)], n[pick], size)
        held = np.repeat(np.column_stack([of_many, of_few]), SKETCHES, axis=1)
        yield node[lo:hi], held.sum(axis=1), np.concatenate([both[0], both[1]], axis=1)[held]


def _contents(sieve: neardup.Sieve):
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(sieve.may_hold(node))
            keep = keep[np.unique(node[keep], return_index=True)[1]]
            texts = b.column("text").take(pa.array(keep))
            for lo, hi, data, offsets in chunks(texts, 1 << 18):
                start, end, counts = words(data, offsets)
                keys, n = shingles(span_hashes(data, start, end, LOWER_CODES), counts)
                keys = labelled(keys, n)
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(node[keep[lo:hi]]), pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64))), *neardup.described(mix(keys, 13), n, WORDS)], ["node", "parts", *neardup.about(WORDS)])

    return contents


def aligned(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """Likeness of two sequences of distinct labelled shingles by their longest common subsequence within the band."""
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return float(n1 == n2)
    band = int((n1 + n2) * (1 - least) / (1 + least)) + 1  # unaligned items of a pair that reaches ``least``
    if abs(n1 - n2) > band:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) / (n1 + n2 - len(i)) < least:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails: list[int] = []  # longest rising subsequence
        for v in j.tolist():
            at = bisect_left(tails, v)
            tails[at : at + 1] = [v]
        m = len(tails)
    return m / (n1 + n2 - m)


def _verified(threshold: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            good = []
            for a, own, other in zip(batch.column("a").to_numpy(), batch.column("parts_a"), batch.column("parts_b"), strict=True):
                if a != last:  # pairs come sorted by a
                    last, x = a, own.values.to_numpy()
                good.append(aligned(x, other.values.to_numpy(), threshold) >= threshold)
            yield batch.select(["a", "b", "la", "lb"]).filter(pa.array(good, pa.bool_()))

    return verified


def with_node(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")


def classes_of(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (hash of the text), class_id of each distinct (doc_id, text): the least id of its class; kept is true for one of each class."""
    rows = with_node(docs)
    texts = rows.select("node", "text")
    members = neardup.shared_buckets(texts, _placed, neardup.parts_for(texts, PART_BYTES))
    sieve = neardup.Sieve(neardup.nodes_of(members), "node")
    contents = texts.mapInArrow(releasing(_contents(sieve)), f"node bigint, parts array<bigint>, {neardup.about_schema(WORDS)}")
    contents = stored(contents.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parts", *neardup.about(WORDS))]), "parts")

    def verify(pairs: DataFrame, n: int) -> DataFrame:
        own = contents.select("node", "parts")
        both = pairs.join(neardup.needed(own, pairs, "b", n), "b").join(neardup.needed(own, pairs, "a", n), "a").select("a", "b", "la", "lb", "parts_a", "parts_b")
        both = few(both, n * neardup.PAIR_ROWS)
        return both.sortWithinPartitions("a").mapInArrow(releasing(_verified(threshold)), "a bigint, b bigint, la bigint, lb bigint")

    labels = neardup.classes(members, contents, verify, threshold, WORDS)
    ids = rows.select("doc_id", "node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")
    heads = ids.groupBy("label").agg(F.min(first).alias("head"))
    ids = ids.join(heads, "label")
    found = ids.select("doc_id", "node", F.col("head.doc_id").alias("class_id"), (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("node") == F.col("head.node"))).alias("kept"))
    found = stored(found, "classes")
    discard(members, contents, labels)
    return found


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more) without all but one document of each class."""
    names = docs.columns
    own, key, node = scratch(names, "own", "key", "node")
    kept = classes_of(docs.select("doc_id", "text"), threshold).where("kept").select(F.col("doc_id").alias(key), F.col("node").alias(node))
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, F.col(own).eqNullSafe(F.col(node)) & F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    return rows.dropDuplicates([own, "doc_id"]).select(*names)
