"""Document fingerprints by closed syncmers, with DataFrame functions only.

A text is cut into pieces: runs without white space, ended after each character of ENDS, so that a cut depends on the
character before it alone. The pieces' 64-bit hashes, K - 1 marks before the first and after the last, form a sequence.
A k-mer is K neighbours in it; it is a closed syncmer if the least of the hashes of its inner substrings (S neighbours)
is the first or the last of them, which depends on nothing outside the k-mer. Syncmers with their places are the
anchors for positional matching.

A whole fingerprint, as the query makes them, holds all distinct anchors (of equal ones the first); its likeness to
another is exact. A bounded one, which ``add_sketch`` makes unless asked for a whole one, holds those whose hash is
among the LEAST least or below a fixed SHARE of all hashes: texts of up to LEAST distinct anchors have all of theirs. As
text it is each anchor's hash and place in hexadecimal. The likeness of two fingerprints matches anchors by position: of those
that both could hold, the common ones in the order of the first text, each of which must come after the one before it
in the second text too, over all: the Jaccard likeness of all anchors, less what is out of order (of bounded fingerprints an
estimate of it).

Null and empty texts, and texts of white space only, share one fingerprint, that of the marks alone. Texts may be of any
length. Repeated rows get equal results; each row keeps its place in the result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .neardup import parts_for
from .shared import stored

K, S, LEAST, SHARE = 5, 2, 64, 1 / 16
#: Characters that end a piece: some of Latin text, and all beyond it.
ENDS = r"eaEA048\x{250}-\x{10FFFF}"
_BELOW = -(1 << 63) + int((1 << 64) * SHARE)
_ALL = (1 << 63) - 1
_NULL_ID = -(1 << 63)
_LOW = 0xFFFFFFFF
#: White space (\s) spelled out: in a class, single characters cost one look-up together.
_WHITE = r" \t\n\x0B\f\r"
#: Text of a range of documents that a window takes.
RANGE_BYTES = 1 << 22


def _steps(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sequence of hashes (``name``_h) and the 0-based places of its closed syncmers (``name``_p).

    Each step is a column of its own, so that an array is built once and not once for each of its elements.
    """
    h, m, p = f"{name}_h", f"{name}_m", f"{name}_p"
    marks = F.array(*[F.lit(-1).cast("bigint")] * (K - 1))
    pieces = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[^{_WHITE}{ENDS}]++[{ENDS}]?+|[{ENDS}]"), F.lit(0)), lambda x: F.xxhash64(x))
    df = df.withColumn(h, F.concat(marks, pieces, marks))
    inner = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(m, inner)
    last = K - S

    def closed(i: Column) -> Column:
        within = [F.get(F.col(m), i + j) for j in range(1, last)]
        return F.least(F.get(F.col(m), i), F.get(F.col(m), i + last)) <= (F.least(*within) if len(within) > 1 else within[0])

    return df.withColumn(p, F.filter(F.sequence(F.lit(0), F.size(h) - K), closed)).drop(m)


def _kmer(name: str, i: Column) -> Column:
    return F.xxhash64(*[F.get(F.col(f"{name}_h"), i + j) for j in range(K)])


def add_sketch(df: DataFrame, text: str, out: str, whole: bool = False) -> DataFrame:
    """Adds ``out``: the fingerprint's anchors as (h, p), ascending, and ``out``_to: the greatest hash it could hold.

    whole: all distinct anchors. Scratch columns begin with ``out``.
    """
    df = _steps(df, text, out)
    df = df.withColumn(f"{out}_s", F.sort_array(F.transform(f"{out}_p", lambda i: F.struct(_kmer(out, i).alias("h"), (i - (K - 1)).cast("int").alias("p")))))
    again = F.size(F.array_distinct(F.col(f"{out}_s")["h"])) < F.size(f"{out}_s")
    df = df.withColumn(f"{out}_d", F.when(again, F.filter(f"{out}_s", lambda x, i: (i == 0) | (F.get(F.col(f"{out}_s"), i - 1)["h"] != x["h"]))).otherwise(F.col(f"{out}_s")))
    if whole:
        return df.withColumn(out, F.col(f"{out}_d")).withColumn(f"{out}_to", F.lit(_ALL)).drop(*[f"{out}_{c}" for c in "hpsd"])
    df = df.withColumn(f"{out}_n", F.greatest(F.lit(LEAST), F.size(F.filter(f"{out}_d", lambda x: x["h"] < F.lit(_BELOW)))))
    df = df.withColumn(out, F.slice(f"{out}_d", F.lit(1), F.col(f"{out}_n")))
    to = F.when(F.size(f"{out}_d") <= F.col(f"{out}_n"), F.lit(_ALL)).otherwise(F.greatest(F.element_at(out, -1)["h"], F.lit(_BELOW - 1)))
    return df.withColumn(f"{out}_to", to).drop(*[f"{out}_{c}" for c in "hpsdn"])


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (number of the k-mer's first piece; negative within the marks) and hash of every closed syncmer."""
    df = _steps(docs.select("doc_id", "text"), "text", "_a")
    df = df.select("doc_id", F.explode(F.transform("_a_p", lambda i: F.struct((i - (K - 1)).alias("place"), _kmer("_a", i).alias("anchor")))).alias("x"))
    return df.select("doc_id", "x.*")


def fingerprint(sketch: str) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.concat(F.lpad(F.hex(x["h"]), 16, "0"), F.lit("@"), F.hex(x["p"].cast("bigint").bitwiseAND(F.lit(_LOW))))), " "))


def add_likeness(df: DataFrame, a: str, b: str, out: str, whole: bool = False) -> DataFrame:
    """Adds ``out``, the likeness of two fingerprints (columns of ``add_sketch``). whole: both are whole."""
    to = F.least(f"{a}_to", f"{b}_to")
    held = lambda c: F.col(c) if whole else F.filter(c, lambda x: x["h"] <= to)
    df = df.withColumns({f"{out}_a": held(a), f"{out}_b": held(b)})
    side = lambda c, k: F.arrays_zip(F.col(c)["h"].alias("h"), F.array_repeat(F.lit(k), F.size(c)).alias("k"), F.col(c)["p"].alias("p"))
    # null where no anchor is common, as of most neighbours
    common = F.arrays_overlap(F.col(f"{out}_a")["h"], F.col(f"{out}_b")["h"])
    df = df.withColumn(f"{out}_u", F.when(common, F.sort_array(F.concat(side(f"{out}_a", 0), side(f"{out}_b", 1)))))
    # the places of a common anchor as one number: sorted as such, they are in the order of the first text
    places = lambda x, y: F.when(x["h"] == y["h"], F.shiftleft(x["p"].cast("bigint"), 32) + y["p"] + K)
    beside = F.zip_with(F.slice(f"{out}_u", F.lit(1), F.size(f"{out}_u") - 1), F.slice(f"{out}_u", F.lit(2), F.size(f"{out}_u")), places)
    df = df.withColumn(f"{out}_m", F.sort_array(F.array_compact(beside)))
    n = F.size(f"{out}_m")
    second = lambda x: x.bitwiseAND(F.lit(_LOW))
    onward = F.zip_with(F.slice(f"{out}_m", F.lit(1), n - 1), F.slice(f"{out}_m", F.lit(2), n), lambda x, y: second(y) > second(x))
    return df.withColumn(out, F.when(F.col(f"{out}_m").isNull(), 0.0).otherwise((1 + F.size(F.filter(onward, lambda x: x))) / (F.size(f"{out}_u") - n))).drop(*[f"{out}_{c}" for c in "abum"])


def next_keys(keys: DataFrame) -> DataFrame:
    """Adds k_next, t_next: the key (k, t) that follows in descending order, after the last the first.

    Keys are dealt out by ranges and stored so; within a range a window finds the next, and the first key of the range
    after comes from a table with one row a range. However ids are spread, a range has about as many keys as others.
    """
    ranged = stored(keys.repartitionByRange(F.desc("k"), F.desc("t")).withColumn("part", F.spark_partition_id()), "document_keys")
    key = F.struct("k", "t")
    heads = ranged.groupBy("part").agg(F.max(key).alias("head"))
    every = Window.orderBy("part")  # as many rows as ranges
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("after"))
    follows = F.lead(key).over(Window.partitionBy("part").orderBy(F.desc("k"), F.desc("t")))
    keys = ranged.withColumn("follows", follows).join(heads, "part").withColumn("follows", F.coalesce("follows", "after"))
    return keys.withColumns({"k_next": F.col("follows.k"), "t_next": F.col("follows.t")}).drop("follows", "after", "part")


def with_edits(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text) its sketch, the next document's and that of an edited text.

    Edited: the last floor(n/3) of n characters replaced by the first as many (or all) of the next document, by
    descending id; after the last comes the first. Rows of one id are ordered by their text's hash and null ids come
    last; rows with the same id and text are one document, with the same result for each.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("k"), F.xxhash64("text").alias("t"))
    # Both joins below read all columns of ``whole``, so that its one exchange of texts serves both.
    whole = add_sketch(rows, "text", "sketch").groupBy("k", "t").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("sketch").alias("sketch"), F.first("sketch_to").alias("sketch_to"))
    links = next_keys(rows.groupBy("k", "t", F.floor(F.length("text") / 3).cast("int").alias("cut")).count())
    after = whole.select(F.col("k").alias("k_next"), F.col("t").alias("t_next"), F.col("doc_id").alias("next_id"), F.col("text").alias("text_next"), F.col("sketch").alias("next_sketch"), F.col("sketch_to").alias("next_sketch_to"))
    given = links.join(after, ["k_next", "t_next"]).select("k", "t", "cut", "count", "next_id", F.expr("left(text_next, cut)").alias("given"), "next_sketch", "next_sketch_to")
    both = whole.join(given, ["k", "t"])
    n = F.length("text")
    both = both.select("doc_id", "count", "next_id", n.cast("bigint").alias("n_chars"), F.concat(F.expr("left(text, length(text) - cut)"), "given").alias("edited"), "sketch", "sketch_to", "next_sketch", "next_sketch_to")
    return add_sketch(both, "edited", "edited_sketch").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("_copy", "count")


def _ranges(rows: DataFrame) -> tuple[Column, Column, int]:
    """The number of each row's range of keys (k, t), counted from the greatest, whether it holds its range's greatest
    key, and how many ranges there are: one for about RANGE_BYTES of text. Only their greatest keys reach the driver."""
    parts = parts_for(rows, RANGE_BYTES)
    ranged = rows.select("k", "t").repartitionByRange(parts, F.desc("k"), F.desc("t")).withColumn("part", F.spark_partition_id())
    heads = sorted(((r.head.k, r.head.t) for r in ranged.groupBy("part").agg(F.max(F.struct("k", "t")).alias("head")).collect()), reverse=True)
    key = F.struct("k", "t")
    bounds = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t).cast("bigint").alias("t")) for k, t in heads]) if heads else F.array(key)
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(max(len(heads), 1).bit_length()))])
    # the last range whose greatest key is not below this one, by halving
    number = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step) >= key, at + step).otherwise(at))
    return number, F.get(bounds, number) == key, max(len(heads), 1)


def with_whole_edits(docs: DataFrame) -> DataFrame:
    """As ``with_edits``, by whole fingerprints.

    Texts are dealt out once, by ranges of their keys; within a range a window finds the next document with its
    fingerprint, and the last of a range takes the first of the range after, from a table with one row a range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("k"), F.xxhash64("text").alias("t"))
    number, leads, ranges = _ranges(rows)
    one = rows.withColumn("range", number).repartition("range").groupBy("range", "k", "t").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("count"))
    one = add_sketch(one, "text", "sketch", whole=True)
    down = Window.partitionBy("range").orderBy(F.desc("k"), F.desc("t"))
    one = one.withColumns({"follows_k": F.lead("k").over(down), "follows_id": F.lead("doc_id").over(down), "follows_text": F.lead("text").over(down), "follows_sketch": F.lead("sketch").over(down)})
    first = rows.where(leads).select(number.alias("first_range"), F.col("doc_id").alias("first_id"), F.col("text").alias("first_text")).dropDuplicates(["first_range"])
    first = add_sketch(first, "first_text", "first_sketch", whole=True).drop("first_sketch_to")
    last = F.col("follows_k").isNull()
    both = one.join(F.broadcast(first), F.when(last, (F.col("range") + 1) % ranges) == F.col("first_range"), "left")
    both = both.withColumns({f"next_{c}": F.when(last, F.col(f"first_{c}")).otherwise(F.col(f"follows_{c}")) for c in ("id", "text", "sketch")})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    both = both.withColumn("cut", cut).withColumn("edited", F.concat(F.expr("left(text, length(text) - cut)"), F.expr("left(next_text, cut)")))
    both = both.select("doc_id", "count", "next_id", n.cast("bigint").alias("n_chars"), "edited", "sketch", "sketch_to", "next_sketch", F.lit(_ALL).alias("next_sketch_to"))
    return add_sketch(both, "edited", "edited_sketch", whole=True).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("_copy", "count")
