"""Fuzzy line dedup: of all lines of the corpus that are alike, one stays.

A line (between line ends, without the white space around it) is the set of its shingles of SHINGLE characters; a
shorter line is one shingle. Its MinHash signature has one value for each of BINS bins: every shingle is hashed once, and
each bin keeps the least of the hashes that fall into it (one permutation hashing); an empty bin takes the value of the
first filled one of a fixed random row of bins (optimal densification), so that two lines agree in a bin with a chance
that is their likeness, however short they are. BANDS bands of ROWS values make
candidates: at likeness 0.8 all bands miss with a chance of 1e-3, at 0.9 of 3e-8; at a likeness of 0.1, as of unrelated
lines, a pair meets with a chance of 2e-5. One replaced character leaves lines of 49 characters and more alike.
Candidates are verified by the exact Jaccard likeness of their shingle sets, distributed union-find makes components of
the links, and in each the line with the least (doc_id, hash of the text, line number) stays; ids that are null come
last. Blank lines always stay. A document keeps its remaining lines in order; one that loses all its lines with
characters goes, one that had none stays as it is. Null texts stay null, each row of them. Rows with equal id and text are one
document: one of them stays, with its other columns. Lines are told apart by a 64-bit hash of their characters. Extra columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .shared import discard, few, releasing, scratch, stored
from .textio import chunks, mix, row_of, span_hashes

SHINGLE, ROWS, BANDS, THRESHOLD = 5, 6, 23, 0.8
BINS = ROWS * BANDS
#: Words of a line's odd sketch, and text for each part of the bands' space.
WORDS, PART_BYTES = 8, 1 << 21
#: Where an empty bin looks for a filled one, before it takes the nearest after it.
_DONORS = ((mix(np.arange(16 * BINS, dtype=np.uint64), 21) >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64).reshape(16, BINS)
_PLACES = np.cumprod(np.r_[np.uint64(1), np.full(SHINGLE - 1, mix(np.arange(1, dtype=np.uint64), 22)[0] | np.uint64(1))])
#: What the values of a band are multiplied by before they are added up.
_TIMES = mix(np.arange(ROWS, dtype=np.uint64), 23) | np.uint64(1)
_EMPTY = np.uint32(0xFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (without white space around) of every line, its number in its text, and lines per text."""
    ends = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(ends, offsets)) + 1
    text = row_of(counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.empty(counts.sum(), np.int64)
    end = np.empty_like(start)
    first = np.cumsum(counts) - counts
    is_first = np.zeros(len(start), bool)
    is_first[first] = True
    start[is_first], start[~is_first] = offsets[:-1], ends + 1
    is_last = np.zeros(len(start), bool)
    is_last[first + counts - 1] = True
    end[is_last], end[~is_last] = offsets[1:], ends
    for at, by in ((start, 1), (end, -1)):
        for turn in range(9):
            if turn == 8:  # long white space: the nearest other characters
                inked = np.flatnonzero(~_WHITE[data])
                place = np.searchsorted(inked, at[white])
                at[white] = np.minimum(np.append(inked, len(data))[place], end[white]) if by > 0 else np.maximum(np.append(-1, inked)[place] + 1, start[white])
                break
            white = np.flatnonzero(start < end) if turn == 0 else white[start[white] < end[white]]
            white = white[_WHITE[data[at[white] - (by < 0)]]]
            if not len(white):
                break
            at[white] += by
    return start, end, number, text


def shingle_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of lines that are not blank, in order, and their number in each line."""
    if len(data) and data.max() >= 128:
        place = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
        a, b = place[start] - 1, place[end - 1]
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    else:
        a, b, codes = start, end, data
    spread = np.append(codes, np.zeros(SHINGLE, codes.dtype)).astype(np.uint64)
    every = spread[SHINGLE - 1 : SHINGLE - 1 + len(codes)] * _PLACES[1]
    for j in range(SHINGLE - 2, 0, -1):
        every += spread[j : j + len(codes)]
        every *= _PLACES[1]
    every += spread[: len(codes)]
    n = np.maximum(b - a - SHINGLE + 1, 1)
    h = every[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
    short = np.flatnonzero(b - a < SHINGLE)
    if len(short):  # whole lines: what follows them counts as one and the same character
        own = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE):
            own += np.where(a[short] + j < b[short], spread[np.minimum(a[short] + j, len(codes))], np.uint64(0x110000)) * _PLACES[j]
        h[(np.cumsum(n) - n)[short]] = own
    return mix(h), n


def signatures(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """lines x BANDS bucket keys (int64) of lines that are not blank."""
    h, n = shingle_hashes(data, start, end)
    own = np.full(len(n) * BINS, _EMPTY, np.uint32)
    np.minimum.at(own, np.repeat(np.arange(len(n)) * BINS, n) + (((h >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)).astype(np.int64), h.astype(np.uint32))
    least = own.copy()
    empty = np.flatnonzero(own == _EMPTY)
    place = empty % BINS
    for donors in _DONORS:
        least[empty] = own[empty - place + donors[place]]
        left = least[empty] == _EMPTY
        empty, place = empty[left], place[left]
    if len(empty):
        rows, at = np.unique(empty // BINS, return_inverse=True)
        filled = own.reshape(-1, BINS)[rows] != _EMPTY
        after = np.where(np.hstack([filled, filled]), np.arange(2 * BINS), 2 * BINS)
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]  # the nearest filled bin from each on
        least[empty] = own[empty - place + after[at, place] % BINS]
    values = least.reshape(len(n), BANDS, ROWS)
    key = np.repeat((np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN)[None], len(n), axis=0)
    for k in range(ROWS):
        key += values[:, :, k] * _TIMES[k]
    return mix(key).view(np.int64)


def _placed(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lines that are not blank, each once in a chunk, how many bands each has, and these."""
    for _, _, data, offsets in chunks(b.column("text"), 1 << 18):
        start, end, _, _ = spans(data, offsets)
        keep = np.flatnonzero(end > start)
        node, once = np.unique(span_hashes(data, start[keep], end[keep]).view(np.int64), return_index=True)
        if len(once):
            yield node, np.full(len(once), BANDS), signatures(data, start[keep[once]], end[keep[once]]).ravel()


def _lines(sieve: neardup.Sieve):
    """Every line that is not blank, and the text of those that may have candidates, once in a chunk."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offsets in chunks(b.column("text"), 1 << 17):
                start, end, number, text = spans(data, offsets)
                keep = np.flatnonzero(end > start)
                start, end = start[keep], end[keep]
                node = span_hashes(data, start, end).view(np.int64)
                some = np.flatnonzero(sieve.may_hold(node))
                told = np.zeros(len(keep), bool)
                told[some[np.unique(node[some], return_index=True)[1]]] = True
                size = np.where(told, end - start, 0)
                ends = np.concatenate([[0], np.cumsum(size)])
                own = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
                own = pa.LargeStringArray.from_buffers(len(keep), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(own), pa.array(told).buffers()[1]).cast(pa.string())
                take = pa.array(text[keep] + lo)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("t").take(take), pa.array(number[keep].astype(np.int32)), pa.array(node), own], ["doc_id", "t", "line", "node", "text"])

    return lines


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offsets in chunks(b.column("text"), 1 << 17):
            h, n = distinct_shingles(data, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([b.column("node")[lo:hi], b.column("text")[lo:hi], *neardup.described(h, n, WORDS)], ["node", "text", *neardup.about(WORDS)])


#: Bits of a shingle's hash that tell it from others of its line.
_TOLD = 44


def distinct_shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes (their first _TOLD bits) of each line, and their number."""
    h, n = shingle_hashes(data, start, end)
    low = np.uint64(64 - _TOLD)
    keys, counts = [], []
    for lo in range(0, len(n), 1 << 20):  # a row number and a hash in one word, so that one sort does
        some = n[lo : lo + (1 << 20)]
        first = int(n[:lo].sum())
        row = row_of(some).astype(np.uint64)
        word = np.sort((row << np.uint64(_TOLD)) | (h[first : first + len(row)] >> low))
        word = word[np.r_[True, word[1:] != word[:-1]]] if len(word) else word
        keys.append((word & np.uint64((1 << _TOLD) - 1)) << low)
        counts.append(np.bincount((word >> np.uint64(_TOLD)).astype(np.int64), minlength=len(some)))
    return (np.concatenate(keys), np.concatenate(counts)) if keys else (h, n)


def shingle_set(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def likeness(x: set[str], y: set[str]) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def common(xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of lines, how many shingles both have and how many either has, told apart by _TOLD bits of their hashes."""
    found = []
    for texts in (xs, ys):
        (_, _, data, offsets), *_ = [*chunks(texts, 1 << 62)]
        found.append(distinct_shingles(data, offsets[:-1], offsets[1:]))
    (hx, nx), (hy, ny) = found
    if len(xs) >> (64 - _TOLD):
        raise ValueError("too many pairs at once")
    word = np.concatenate([(row_of(n).astype(np.uint64) << np.uint64(_TOLD)) | (h >> np.uint64(64 - _TOLD)) for h, n in found])
    word.sort(kind="stable")  # two sorted runs
    both = np.bincount((word[1:][word[1:] == word[:-1]] >> np.uint64(_TOLD)).astype(np.int64), minlength=len(xs))
    return both, nx + ny - both


def _verified(threshold: float):
    """Pairs whose hashed shingles leave no doubt are decided by these, the others by the shingles themselves."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column("text_a"), 1 << 17):
                some = batch.slice(lo, hi - lo)
                x, y = some.column("text_a"), some.column("text_b")
                both, either = common(x, y)
                good = both >= threshold * either
                for k in np.flatnonzero(np.abs(both - threshold * either) <= 2).tolist():  # two clashes of hashes in a line at most
                    good[k] = likeness(shingle_set(x[k].as_py()), shingle_set(y[k].as_py())) >= threshold
                yield some.select(["a", "b", "la", "lb"]).filter(pa.array(good, pa.bool_()))

    return verified


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text")


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t (hash of the text), line: of each document that loses lines, their numbers from 0."""
    rows = _keyed(docs)
    texts = rows.select("text").where(F.col("text").isNotNull())
    members = neardup.shared_buckets(texts, _placed, neardup.parts_for(texts, PART_BYTES))
    lines = rows.where(F.col("text").isNotNull()).mapInArrow(releasing(_lines(neardup.Sieve(neardup.nodes_of(members), "node"))), "doc_id bigint, t bigint, line int, node bigint, text string")
    lines = stored(lines, "lines")
    contents = lines.where(F.col("text").isNotNull()).groupBy("node").agg(F.first("text").alias("text"))
    contents = stored(contents.mapInArrow(releasing(_described), f"node bigint, text string, {neardup.about_schema(WORDS)}"), "line_texts")

    def verify(pairs: DataFrame, n: int) -> DataFrame:
        own = contents.select("node", "text")
        both = pairs.join(neardup.needed(own, pairs, "b", n), "b").join(neardup.needed(own, pairs, "a", n), "a").select("a", "b", "la", "lb", "text_a", "text_b")
        both = few(both, n * neardup.PAIR_ROWS)
        return both.mapInArrow(releasing(_verified(threshold)), "a bigint, b bigint, la bigint, lb bigint")

    labels = neardup.classes(members, contents, verify, threshold, WORDS)
    discard(members, contents)
    # A line that has others like it: its group (its class's label, else itself) and the least id in the group.
    none = F.lit(None).cast("bigint")
    classed = labels.union(labels.select("label", "label").distinct()).select("node", "label", F.lit(0).alias("times"), none.alias("least"))
    own = lines.select("node", none.alias("label"), F.lit(1).alias("times"), F.col("doc_id").alias("least")).union(classed)
    own = own.groupBy("node").agg(F.max("label").alias("label"), F.sum("times").alias("times"), F.min("least").alias("least"))
    own = stored(own.where("label IS NOT NULL OR times > 1").select("node", F.coalesce("label", "node").alias("group"), "least"), "repeated")
    heads = own.select("node", "group").join(own.groupBy("group").agg(F.min("least").alias("least")), "group")
    some = stored(lines.select("doc_id", "t", "line", "node").join(heads, "node").drop("node"), "repeated_lines")
    discard(labels, lines, own)
    best = some.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("group").agg(F.min(F.struct("t", "line")).alias("best"))
    return some.join(best, "group").where(~F.struct("doc_id", "t", "line").eqNullSafe(F.struct("least", "best.t", "best.line"))).select("doc_id", "t", "line")


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The remaining text; null where lines with characters were lost and none remains."""
    for texts, lost in batches:
        out = []
        for own, gone in zip(texts.to_pylist(), lost.to_pylist(), strict=True):
            gone = set(gone or ())
            kept = [x for k, x in enumerate(own.split("\n")) if k not in gone]
            out.append("\n".join(kept) if not gone or any(x.strip(" \t\r\x0b\x0c") for x in kept) else None)
        yield pa.array(out, pa.string())


_cut.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, more) with the remaining text.

    Documents that lose no line pass by the exchange, as far as a bitmap of fixed size can tell, and by Python.
    """
    names = docs.columns
    t, id_, null, key, may, lost_key, gone, cut = scratch(names, "t", "id", "null", "key", "may", "lost_key", "gone", "cut")
    by = [id_, null, t]
    told = [F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(null)]
    again = _keyed(docs).where("t IS NOT NULL AND text IS NOT NULL").groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t", F.lit(None).cast("int").alias("line"))
    lost = removed_lines(docs, threshold).union(again).groupBy("doc_id", "t").agg(F.collect_set("line").alias(gone))
    lost = stored(lost.select(F.xxhash64("doc_id", "t").alias(lost_key), *told, F.col("t").alias(t), gone), "lost")
    sieve = neardup.Sieve(lost, lost_key)

    def may_lose(keys: pa.Array) -> pa.Array:
        return pa.array(sieve.may_hold(keys.to_numpy(zero_copy_only=False)))

    may_lose.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    rows = docs.withColumn(t, F.xxhash64("text")).withColumn(key, F.xxhash64("doc_id", t)).withColumn(may, F.arrow_udf(may_lose, "boolean")(key))
    apart = rows.where(F.col("text").isNull() | ~F.col(may)).select(*names)
    # Joined and made distinct by the same three columns, so that texts are exchanged once.
    some = rows.where(F.col("text").isNotNull() & F.col(may)).select(*names, t, *told).join(lost.drop(lost_key), by, "left")
    some = some.dropDuplicates(by).withColumn(cut, F.arrow_udf(releasing(_cut), "string")("text", gone)).where(F.col(cut).isNotNull())
    return apart.union(some.select(*[F.col(cut).alias("text") if n == "text" else F.col(n) for n in names]))
