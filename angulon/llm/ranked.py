"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of digits, letters A-Z (in lower case) and characters beyond ASCII. With N documents that have
terms, L terms in all and n in a document, its normaliser is m = 50 + (50 n N) div L. Documents of equal m are a stratum,
cut into blocks of at most BLOCK_DOCS documents and about BLOCK_BYTES of text (a longer text is a block of its own,
whole). A block is one row of the index: its documents, its terms, and for each term and each tf the documents that have
it so often. A third of all documents may share one m: strata are dealt out by a rebalancing exchange, which splits them.

For a set of items, df and weights w of their terms come from one pass over the index. A block bounds the score that an
item can reach in it by the impacts w * ((10**9 tf) div (1000 tf + 20 m)) of its greatest tf of each term. The FIRST blocks
of each item by falling bound are scored first; the item's top-th best score there is a floor that any document of its
result reaches. All blocks are then visited, by falling bound within a batch, for those items only whose bound reaches
the floor, which rises as a task goes on. An impact is computed once for each term and tf of a block. Nothing is cut: a
document left out has a bound below ``top`` documents already scored.

Items are taken in groups of about GROUP terms, whose table is shipped to the tasks; the index is read again for each.

Null texts, and texts without terms, are in no block. Rows may repeat; each ranks on its own. Equal scores rank by
ascending id, null ids last, repeated rows in any order (they are equal). Rows of one item id are one item with the terms
of all. Items without terms, and empty tables, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, releasing, stored
from .textio import chunks, row_of, runs

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_DOCS, BLOCK_BYTES, TOP, FIRST, GROUP = 4096, 1 << 20, 50, 3, 500_000
#: Postings that are added up at once.
ADDED = 1 << 19
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
INDEX_SCHEMA = "block bigint, m bigint, docs array<bigint>, terms array<string>, list_term array<int>, list_tf array<int>, list_size array<smallint>, postings array<smallint>"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Every term of the texts in turn, and the number of terms of each."""
    start, end, counts = runs(_INSIDE[data], offsets)
    inside = data[_INSIDE[data]]
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.tobytes()), pa.py_buffer(_TO_LOWER[inside].tobytes())), counts


def term_counts(text: Column) -> Column:
    """How many terms a text has, with repeats."""

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            n = []
            for _, _, data, offsets in chunks(b, BLOCK_BYTES):
                inside = _INSIDE[data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                first[offsets[:-1][np.diff(offsets) > 0]] = inside[offsets[:-1][np.diff(offsets) > 0]]
                upto = np.concatenate([[0], np.cumsum(first)])
                n.append(upto[offsets[1:]] - upto[offsets[:-1]])
            yield pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())

    counted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(releasing(counted), "bigint")(text)


def block_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, and of each list (by term, then tf): its term, tf and size; and the documents' places, list by list."""
    all_terms, counts = tokens(data, offsets)
    coded = pc.dictionary_encode(all_terms)
    keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(counts) + row_of(counts), return_counts=True)
    term, doc = np.divmod(keys, max(len(counts), 1))
    order = np.lexsort((doc, tf, term))
    term, doc, tf = term[order], doc[order], tf[order]
    first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(tf) != 0)]) if len(term) else np.zeros(0, np.int64)
    return coded.dictionary, term[first], tf[first], np.diff(np.r_[first, len(term)]), doc


def _one(values, kind: pa.DataType) -> pa.Array:
    """An array that is one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 32
    for b in batches:  # by rising m
        m = b.column("m").to_numpy()
        for lo in np.flatnonzero(np.r_[len(m) > 0, np.diff(m) != 0]):
            stratum = b.slice(lo, int(np.searchsorted(m, m[lo], "right")) - lo)
            for k in range(0, stratum.num_rows, BLOCK_DOCS):
                part = stratum.slice(k, BLOCK_DOCS)
                for i, j, data, offsets in chunks(part.column("text"), BLOCK_BYTES):
                    terms, term, tf, size, doc = block_of(data, offsets)
                    ids = part.column("doc_id").slice(i, j - i)
                    lists = [_one(v, kind) for v, kind in ((term, pa.int32()), (tf, pa.int32()), (size, pa.int16()), (doc, pa.int16()))]  # BLOCK_DOCS fits 16 bits
                    yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([m[lo]], pa.int64()), _one(ids, pa.int64()), _one(terms, pa.string()), *lists], ["block", "m", "docs", "terms", "list_term", "list_tf", "list_size", "postings"])
                    made += 1


def build(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The index of all documents (a stored table), N and L."""
    sized = docs.select("doc_id", "text", term_counts(F.col("text")).alias("terms")).where("terms > 0")
    n_docs, total = sized.agg(F.count("*"), F.coalesce(F.sum("terms"), F.lit(0))).first()
    m = F.expr(f"50 + (50 * terms * {n_docs}L) div {max(total, 1)}L")
    dealt = sized.select("doc_id", "text", m.alias("m")).hint("rebalance", "m").sortWithinPartitions("m")
    return stored(dealt.mapInArrow(releasing(_blocks), INDEX_SCHEMA), "index"), n_docs, total


class Items:
    """Items and their terms, as arrays: pairs of a term and an item, by term."""

    def __init__(self, rows: list) -> None:
        self.ids = [r.item_id for r in rows]
        terms = sorted({t for r in rows for t in r.terms})
        at = {t: k for k, t in enumerate(terms)}
        pairs = sorted((at[t], i) for i, r in enumerate(rows) for t in r.terms)
        self.terms = pa.array(terms, pa.string())
        self.pair_term, self.pair_item = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.weight = np.zeros(len(terms), np.int64)
        self.floor = np.ones(len(rows), np.int64)


class Block:
    """A row of the index as the items see it: lists of their terms only."""

    def __init__(self, row: pa.RecordBatch, items: Items) -> None:
        column = lambda c: row.column(c).flatten()
        self.block, self.m, self.docs = row.column("block")[0].as_py(), row.column("m")[0].as_py(), column("docs")
        known = pc.fill_null(pc.index_in(column("terms"), value_set=items.terms), -1).to_numpy()
        term, size = known[column("list_term").to_numpy()], column("list_size").to_numpy().astype(np.int64)
        kept = term >= 0
        self.of_lists = lambda: column("postings").to_numpy()[np.repeat(kept, size)]
        self.term, self.tf, self.size = term[kept], column("list_tf").to_numpy()[kept].astype(np.int64), size[kept]

    def df(self, n: int) -> np.ndarray:
        return np.bincount(self.term, self.size, n).astype(np.int64)

    def weigh(self, items: Items) -> None:
        """Impact of each list, greatest impact of each term, and bound of each item."""
        self.impact = items.weight[self.term] * ((1_000_000_000 * self.tf) // (1000 * self.tf + 20 * self.m))
        greatest = np.zeros(len(items.weight), np.int64)
        np.maximum.at(greatest, self.term, self.impact)
        self.bound = np.zeros(len(items.ids), np.int64)
        np.add.at(self.bound, items.pair_item, greatest[items.pair_term])

    def scores(self, items: Items, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """item, places of documents and their scores, where these reach the item's floor; of the wanted items."""
        n = len(self.docs)
        held = np.bincount(self.term, self.size, len(items.weight)).astype(np.int64)
        # lists are by the block's own terms: by those of the items
        order = np.argsort(self.term, kind="stable")
        size = self.size[order]
        ends = np.cumsum(self.size)
        at = _ranges(ends[order] - size, size)
        doc, impact = self.of_lists()[at], np.repeat(self.impact[order], size)
        begin = np.cumsum(held) - held
        pick = np.flatnonzero(wanted[items.pair_item] & (held[items.pair_term] > 0))
        pick = pick[np.argsort(items.pair_item[pick], kind="stable")]
        item, term = items.pair_item[pick], items.pair_term[pick]
        load = np.cumsum(held[term])
        lo = 0
        while lo < len(pick):  # whole items, of about ADDED postings
            hi = int(np.searchsorted(load, (load[lo - 1] if lo else 0) + ADDED, "right"))
            hi = max(hi, int(np.searchsorted(item, item[lo], "right")))
            hi = len(pick) if hi >= len(pick) else max(int(np.searchsorted(item, item[hi], "left")), int(np.searchsorted(item, item[lo], "right")))
            some, local = np.unique(item[lo:hi], return_inverse=True)
            at = _ranges(begin[term[lo:hi]], held[term[lo:hi]])
            cell = np.repeat(local, held[term[lo:hi]]) * n + doc[at]
            if self.bound[some].max() < 1 << 53:  # exact in doubles
                total = np.bincount(cell, impact[at], len(some) * n).astype(np.int64)
            else:
                total = np.zeros(len(some) * n, np.int64)
                np.add.at(total, cell, impact[at])
            total = total.reshape(len(some), n)
            for k, i in enumerate(some):
                good = np.flatnonzero(total[k] >= items.floor[i])
                if len(good):
                    yield int(i), good, total[k][good]
            lo = hi


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0].., size[0] of them, then first[1].., and so on."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _best(score: np.ndarray, doc: np.ndarray, null: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((doc, null, -score))[:top]


class Found:
    """The best documents of each item so far."""

    def __init__(self, items: Items, top: int) -> None:
        self.items, self.top, self.of = items, top, {}

    def add(self, block: Block, wanted: np.ndarray) -> None:
        ids, null = block.docs.fill_null(0).to_numpy(), block.docs.is_null().to_numpy(zero_copy_only=False)
        for i, place, score in block.scores(self.items, wanted):
            new = (score, ids[place], null[place])
            have = self.of.get(i)
            both = tuple(np.concatenate([a, b]) for a, b in zip(have, new, strict=True)) if have else new
            keep = _best(*both, self.top)
            self.of[i] = tuple(a[keep] for a in both)
            if len(keep) == self.top:
                self.items.floor[i] = max(self.items.floor[i], self.of[i][0][-1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, (score, doc, null) in self.of.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])


FOUND_SCHEMA = "item bigint, doc_id bigint, score bigint"


def _rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, 1) for k in range(b.num_rows))


def _searched(index: DataFrame, shipped, top: int) -> DataFrame:
    """The best documents of each item in each task's blocks. A column ``items`` of the index, if there, names those to score."""
    some = "items" in index.columns

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = copy(shipped.value)
        items.floor = items.floor.copy()  # rises within this task only
        found = Found(items, top)
        for b in batches:
            blocks = []
            for row in _rows(b):
                block = Block(row, items)
                block.weigh(items)
                asked = np.ones(len(items.ids), bool)
                if some:
                    asked[:] = False
                    asked[row.column("items").flatten().to_numpy()] = True
                blocks.append((block, asked))
            for block, asked in sorted(blocks, key=lambda x: -int(x[0].bound.max(initial=0))):
                found.add(block, asked & (block.bound >= items.floor))
        yield from found.rows()

    return index.mapInArrow(releasing(searched), FOUND_SCHEMA)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def search(index: DataFrame, n_docs: int, items: Items, top: int = TOP) -> DataFrame:
    """item (its place in ``items``), rank, doc_id, score."""
    spark = index.sparkSession
    n = len(items.weight)
    first = spark.sparkContext.broadcast(items)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for b in batches:
            for row in _rows(b):
                df += Block(row, first.value).df(n)
        here = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(df[here])], ["term", "df"])

    df = np.zeros(n, np.int64)
    for r in index.mapInArrow(releasing(held), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of the items
        df[r.term] = r.df
    items.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    weighed = spark.sparkContext.broadcast(items)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(weighed.value.ids), FIRST, 2), np.int64)
        for b in batches:
            for row in _rows(b):
                block = Block(row, weighed.value)
                block.weigh(weighed.value)
                new = np.column_stack([block.bound, np.full(len(block.bound), block.block)])[:, None]
                both = np.concatenate([best, new], axis=1)
                best = np.take_along_axis(both, np.argsort(-both[:, :, :1], axis=1, kind="stable"), axis=1)[:, :FIRST]
        item, k = np.nonzero(best[:, :, 0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, k, 0]), pa.array(best[item, k, 1])], ["item", "bound", "block"])

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    chosen = index.mapInArrow(releasing(bounds), "item bigint, bound bigint, block bigint").withColumn("rank", rank).where(F.col("rank") <= FIRST)
    chosen = chosen.groupBy("block").agg(F.collect_list("item").alias("items"))  # FIRST for each item
    begun = _ranked(_searched(index.join(F.broadcast(chosen), "block"), weighed, top), top)
    for r in begun.where(F.col("rank") == top).select("item", "score").collect():  # one row an item
        items.floor[r.item] = r.score
    return _ranked(_searched(index, spark.sparkContext.broadcast(items), top), top)


def rank_all(docs: DataFrame, asked: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item (item_id, text)."""
    spark: SparkSession = docs.sparkSession
    kind = asked.schema["item_id"].dataType.simpleString()
    wanted = asked.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    wanted = stored(wanted, "items")
    size = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = -(-size // GROUP)
    index, n_docs, total = build(docs)
    out = None
    for g in range(groups if total else 0):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # about GROUP terms
        if not rows:
            continue
        items = Items(rows)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], f"item bigint, item_id {kind}")
        found = stored(search(index, n_docs, items, top).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        out = found if out is None else out.union(found)
    discard(index, wanted)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
