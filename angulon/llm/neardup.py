"""What near-duplicate operators share: classes of similar nodes from buckets of candidates.

A bucket holds nodes that may be similar. Every pair within a bucket is either shown not to be similar, or verified, or
already in one class, without listing all pairs of a group. First every node meets one of each of its buckets, the node
that was read first: pairs that many buckets give are compared once, and buckets of two nodes, or whose nodes share a
class by now, are done. In the others the next 4 * 16**r nodes, their leaders, meet in round r the later ones that are
not yet in the leader's class; classes that a found link joins become one, and a bucket is done when its remaining nodes
share a class. A group of thousands of copies takes a few comparisons for each of its nodes.

Where a leader meets a node, an odd sketch decides first: a number of bits, of which bit ``hash mod bits`` is turned over
for each of a node's parts (shingles). Each bit in which two sketches differ stands for at least one part that only one
of the nodes has, which bounds their likeness from above. Sketches of nodes with many parts fill up; so a pair is also
ruled out if more bits differ than a pair at the threshold would have, by SIGMAS standard deviations (a chance of 1e-9
for a pair at the threshold; much less above it). Pairs ruled out never leave the join. Large buckets are dealt out by a
salt of the node, to which their leaders are copied.

Buckets are found by one exchange of packed keys: a task sorts what it has by parts of the key space, and each part is
read by one task in turn, which keeps the first node of each key and gives out the later ones with it. What a task holds
is bounded by the distinct keys of a part, whose number the caller sets by the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, few, free_exchanges, releasing, stored
from .textio import mix, row_of

FIRST_LEADERS, MORE_LEADERS, SALT_ROWS, SIGMAS = 4, 16, 256, 6.0
#: So many rows of small tables a pair to be verified counts for; pairs up to which their nodes are broadcast.
PAIR_ROWS, BROADCAST_PAIRS = 10, 300_000
#: Keys that a task packs at once, and that a part's reader merges at once.
PACKED, MERGED = 1 << 20, 1 << 19
#: A packed key: what is left of a bucket within its part, and the node.
ENTRY = np.dtype([("rest", "V5"), ("node", "<i8")])


def about(words: int) -> list[str]:
    """The columns that describe a node: number of its parts, and their odd sketch of ``words`` 64-bit words."""
    return ["size", *(f"w{k}" for k in range(words))]


def about_schema(words: int) -> str:
    return ", ".join(f"{c} bigint" for c in about(words))


def described(keys: np.ndarray, counts: np.ndarray, words: int) -> list[pa.Array]:
    """The columns ``about`` of nodes with the given part hashes (distinct within a node) and numbers of parts."""
    bits = 64 * words
    at = (keys >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = []
    step = max(1, (1 << 22) // bits)
    for k in range(0, max(len(counts), 1), step):
        some = counts[k : k + step]
        cells = row_of(some) * bits + at[ends[k] : ends[k + len(some)]]
        odd = (np.bincount(cells, minlength=len(some) * bits) & 1).astype(np.uint8).reshape(len(some), bits)
        out.append(np.packbits(odd, axis=1, bitorder="little").view("<i8"))
    made = np.concatenate(out).reshape(len(counts), words)
    return [pa.array(counts.astype(np.int64)), *(pa.array(np.ascontiguousarray(made[:, k])) for k in range(words))]


def _within(threshold: float, words: int) -> Column:
    """Whether the odd sketches leave room for the threshold, of columns ``about`` and the same with ``a_``."""
    bits = 64.0 * words
    differ = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"a_w{k}"))) for k in range(1, words)), F.bit_count(F.col("w0").bitwiseXOR(F.col("a_w0"))))
    both = F.col("size") + F.col("a_size")
    apart = F.greatest(differ, F.abs(F.col("size") - F.col("a_size")))
    most = both * ((1 - threshold) / (1 + threshold))  # parts that only one node of a pair at the threshold has
    usual = bits / 2 * (1 - F.exp(-2 * most / bits)) + SIGMAS * F.sqrt(bits / 4 * (1 - F.exp(-4 * most / bits))) + 1
    return (apart <= most + 1e-9) & (differ <= usual)


def _is_forest_of_stars(edges: DataFrame, n: int) -> bool:
    """Whether every node is either below one other or above others."""
    ends = edges.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = few(ends, 2 * n).groupBy("u").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    return few(nodes, n).where("below > 1 OR (below > 0 AND above > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, label: each node of the edges (a, b) but the least of its component, which is the label. Large and small
    stars in turn, until every component is one star."""
    stars = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while (n := stars.count()) and not _is_forest_of_stars(stars, n):
        both = few(stars, n).union(few(stars.select("v", "u"), n))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        least = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, stars = stars, stored(few(few(small, n).distinct(), n), "stars")
        discard(old)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label"))


#: Of a batch, its nodes, how many buckets each has, and these, one after another.
Placed = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _in_order(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by key, then by the others: most keys come once, so the others are compared for the rest alone."""
    order = np.argsort(key)
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    run = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if len(run):
        some = order[run]
        order[run] = some[np.lexsort((*[t[some] for t in reversed(then)], key[some]))]
    return order


def _packed(place: Placed, parts: int):
    """part, entries: what a task has for each part of the key space, packed."""
    width = np.uint64((1 << 64) // parts + 1)

    def flush(nodes: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = _in_order(key, node)
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        part = key // width
        rest = (key - part * width) >> np.uint64(max(0, int(width).bit_length() - 40))
        entries = np.empty(len(key), ENTRY)
        entries["rest"] = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").ravel()
        entries["node"] = node
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[first[1:], len(key)]
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[first, len(key)].astype(np.int64) * ENTRY.itemsize), pa.py_buffer(entries.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64)), pa.array(ends - first), data], ["part", "n", "entries"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, held = [], [], 0
        for b in batches:
            for node, counts, key in place(b):
                nodes.append(np.repeat(node, counts))
                keys.append(key.view(np.uint64))
                held += len(key)
                if held >= PACKED:
                    yield flush(nodes, keys)
                    nodes, keys, held = [], [], 0
        if held:
            yield flush(nodes, keys)

    return packed


class _Part:
    """The keys of a part seen so far, sorted, each with its first node, and whether others were given out."""

    def __init__(self, number: int) -> None:
        self.number, self.key, self.node, self.again = number, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, entries: bytes) -> Iterator[pa.RecordBatch]:
        self.waiting.append(np.frombuffer(entries, ENTRY))
        self.held += len(self.waiting[-1])
        if self.held >= MERGED:
            yield from self.merge(False)

    def merge(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Gives out the new nodes of keys that have another first one."""
        if not self.waiting:
            return
        entries = np.concatenate(self.waiting)
        rest = np.zeros((len(entries), 8), np.uint8)
        rest[:, :5] = np.ascontiguousarray(entries["rest"]).view(np.uint8).reshape(-1, 5)
        key = np.concatenate([self.key, rest.view(np.uint64).ravel()])
        node = np.concatenate([self.node, entries["node"]])
        new = np.concatenate([np.zeros(len(self.key), bool), np.ones(len(entries), bool)])
        again = np.concatenate([self.again, np.zeros(len(entries), bool)])
        order = _in_order(key, new, node)
        key, node, again = key[order], node[order], again[order]
        same = np.r_[False, key[1:] == key[:-1]]
        first = np.flatnonzero(~same)
        size = np.diff(np.r_[first, len(key)])
        out = same & (node != np.repeat(node[first], size)) & np.r_[True, node[1:] != node[:-1]]
        count = np.add.reduceat(out.astype(np.int64), first)
        again = again[first]
        if out.any():
            bucket = mix(key[out] + np.uint64(self.number * 0x9E3779B97F4A7C15 % (1 << 64)), 5).view(np.int64)
            more = np.repeat(again | (count > 1) | (not last), size)[out]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.repeat(node[first], size)[out]), pa.array(node[out]), pa.array(more)], ["bucket", "a", "b", "more"])
        self.key, self.node, self.again = key[first], node[first], again | (count > 0)
        self.waiting, self.held = [], 0


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = None
    for b in batches:  # by part
        for number, entries in zip(b.column("part").to_pylist(), b.column("entries"), strict=True):
            if part is None or number != part.number:
                if part is not None:
                    yield from part.merge(True)
                part = _Part(number)
            yield from part.add(entries.as_buffer())
    if part is not None:
        yield from part.merge(True)


def shared_buckets(rows: DataFrame, place: Placed, parts: int) -> DataFrame:
    """bucket, a, b, more: for each bucket its first node a with every other one b; ``more`` is true at least where a
    bucket has more than two nodes. A row may come more than once.

    Equal entries of a task's chunk are one, so a bucket of which a third of all rows have a copy of one node is no
    heavier than others; one with very many nodes is given out as it is read.
    """
    packed = rows.mapInArrow(releasing(_packed(place, parts)), "part bigint, n bigint, entries binary")
    found = packed.repartition("part").sortWithinPartitions("part").mapInArrow(releasing(_merged), "bucket bigint, a bigint, b bigint, more boolean")
    members = stored(found, "buckets")
    free_exchanges(members.sparkSession)
    return members


def nodes_of(members: DataFrame) -> DataFrame:
    """node: those of the rows that shared_buckets gives, not distinct."""
    return members.select(F.explode(F.array("a", "b")).alias("node"))


def parts_for(texts: DataFrame, part_bytes: int) -> int:
    """Into how many parts the keys of texts (column text) are cut: one for each ``part_bytes`` of text."""
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(16, -(-size // part_bytes))


def _mixed(members: DataFrame) -> DataFrame:
    """bucket, n: the buckets whose nodes do not all share one label, and their number of nodes."""
    return members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")


def needed(contents: DataFrame, pairs: DataFrame, side: str, n: int) -> DataFrame:
    """The rows of ``contents`` (node, ...) whose node is on a side of the n pairs. Where these are few they are broadcast,
    and nothing else of the contents is exchanged."""
    rows = contents.withColumnsRenamed({c: f"{c}_{side}" for c in contents.columns if c != "node"}).withColumnRenamed("node", side)
    return rows.join(F.broadcast(pairs.select(side).distinct()), side, "left_semi") if n <= BROADCAST_PAIRS else rows


def classes(members: DataFrame, nodes: DataFrame, verify: Callable[[DataFrame, int], DataFrame], threshold: float, words: int) -> DataFrame:
    """node, label for every node that has a link: label is the least node of its class, which is not listed itself.

    members: (bucket, a, b, more), as shared_buckets gives them. nodes: node and the columns ``about``, one row a
    node. verify: of distinct pairs (a, b, la, lb), and their number, those whose nodes a and b are similar.
    """
    nodes = nodes.select("node", *about(words))
    def links_of(members: DataFrame, leaders: DataFrame, n: int) -> DataFrame:
        """Verified pairs of leaders (bucket, salts, a_...) and later members in other classes; n: most pairs there are."""
        everywhere = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        pairs = members.join(everywhere, ["bucket", "salt"]).where((F.col("node") > F.col("a_node")) & (F.col("label") != F.col("a_label")) & _within(threshold, words))
        pairs = pairs.select(F.col("a_node").alias("a"), F.col("node").alias("b"), F.col("a_label").alias("la"), F.col("label").alias("lb"))
        return linked(few(few(pairs, n).distinct(), n))

    def linked(pairs: DataFrame) -> DataFrame:
        """The verified ones of distinct pairs."""
        pairs = stored(pairs, "pairs")
        found = pairs.count()
        if not found:
            return pairs
        links = stored(verify(few(pairs, found * PAIR_ROWS), found), "links")
        discard(pairs)
        return links

    def moves(links: DataFrame) -> DataFrame:
        return components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))

    firsts = members.select(F.least("a", "b").alias("a_node"), F.greatest("a", "b").alias("node")).distinct()
    firsts = firsts.join(nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns]), "a_node").join(nodes, "node").where(_within(threshold, words))
    links = linked(firsts.select(F.col("a_node").alias("a"), F.col("node").alias("b"), F.col("a_node").alias("la"), F.col("node").alias("lb")))
    found = stored(moves(links).select(F.col("label").alias("node"), F.col("to").alias("label")), "found")
    labelled = members.where("more").select("bucket", F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left")
    labelled = stored(labelled.select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")
    salts = F.greatest(F.ceil(F.col("n") / SALT_ROWS), F.lit(1)).cast("int")
    dealt = labelled.join(_mixed(labelled), "bucket").select("bucket", salts.alias("salts"), F.pmod(F.hash("node"), salts).alias("salt"), "node", "label")
    open_still = stored(dealt.join(nodes, "node"), "members")
    discard(links, labelled)
    free_exchanges(open_still.sparkSession)
    members, wanted = open_still, FIRST_LEADERS
    while n := members.count():  # of a stored table: read off its files
        first = few(members.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("node"))).where(F.col("r") <= wanted), n)
        leaders = few(first.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("node"))).where(F.col("r") <= wanted), n)
        leaders = stored(leaders.select("bucket", "salts", *[F.col(c).alias(f"a_{c}") for c in ("node", "label", *about(words))]), "leaders")
        links = links_of(members, leaders, n * max(1, wanted // 16))
        old = [members, leaders, links]
        if not links.isEmpty():
            moved = moves(links)
            old += [found]
            found = stored(_follow(found, moved), "found")
            members = members.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        last = leaders.groupBy("bucket").agg(F.max("a_node").alias("last"))
        rest = stored(few(members.join(few(last, n), "bucket").where("node > last").drop("last"), n), "rest")
        members = stored(few(rest.join(few(_mixed(rest), n), "bucket", "left_semi"), n), "members")
        discard(*old, rest)
        free_exchanges(members.sparkSession)
        wanted *= MORE_LEADERS
    return found


def _follow(found: DataFrame, moved: DataFrame) -> DataFrame:
    """Earlier labels replaced by those they moved to, and the nodes that were their own label until now."""
    return found.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")).union(moved.select("label", "to"))


class Sieve:
    """A bitmap of hashed keys with a fixed number of bits: false only for keys that are not among those given.

    Its size (``bits`` / 8 bytes at most) does not grow with the keys; with very many of them it lets more others pass,
    which a later join removes.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 1 << 26) -> None:
        at = few(keys.select((F.pmod(F.col(column), F.lit(bits)) + 1).alias("at")), keys.count())
        rows = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect()
        size = 1 << 15
        whole = np.zeros(bits // 8, np.uint8)
        for r in rows:  # bits / 32768 rows at most, numbered from 1
            whole[(r.k - 1) * size // 8 : r.k * size // 8] = np.frombuffer(r.bitmap, np.uint8)
        self.bits, self.shipped = bits, keys.sparkSession.sparkContext.broadcast(whole)

    def __getstate__(self):
        return {"bits": self.bits, "shipped": self.shipped}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys % self.bits
        return (self.shipped.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
