"""Quality filters, redundant measurements of one residue, non-redundant sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, codons
from . import blocks, lcs

KEY = ["condition", "unp_id", "unp_idx", "codon"]


def quality_filter(df: DataFrame, strict: bool = True, consolidate: bool = True) -> DataFrame:
    """Residues with a secondary-structure class, a position and a known codon; strict: an unambiguous one."""
    if consolidate:
        df = df.withColumn("secondary", codons.consolidate_ss("secondary"))
    keep = F.col("secondary").isNotNull() & F.col("unp_idx").isNotNull() & ~F.col("codon").isin(codons.UNKNOWN, codons.MISSING)
    return df.where(keep & (F.col("codon_score") == 1) if strict else keep)


def aggregate_redundant(df: DataFrame, how: str = "cent", min_size: int = 1, condition: str | None = "secondary", resolution: str = "resolution", spread: bool = True) -> DataFrame:
    """One row for each (condition, unp_id, unp_idx, codon): angles, group size and spread.

    A group is dropped if it has an angle missing, more than one secondary structure or fewer than ``min_size``
    members. how: ``cent`` gives the circular centroid, ``res`` the member of the best resolution (ties: least
    struct_id), ``none`` every member. std is the root mean squared torus distance to the angles given, for which the
    members are read again; without ``spread`` it is null and one exchange does.
    """
    df = df.withColumn("condition", F.col(condition) if condition else F.lit("ANY"))
    best = [F.min(F.struct(F.coalesce(resolution, F.lit(float("-inf"))), "struct_id", "phi", "psi")).alias("top")] if how == "res" else []
    sums = [angles.exact_sum(f(F.radians(c))).alias(f"{g}_{c}") for c in ("phi", "psi") for g, f in (("s", F.sin), ("c", F.cos))] if how == "cent" else []
    whole = F.min((F.col("phi").isNotNull() & F.col("psi").isNotNull()).cast("int"))
    groups = df.groupBy(*KEY).agg(F.count("*").alias("group_size"), whole.alias("whole"), F.min("secondary").alias("_least"), F.max("secondary").alias("_secondary"), *sums, *best)
    one_class = F.col("_least").isNull() | (F.col("_least") == F.col("_secondary"))
    groups = groups.where((F.col("group_size") >= min_size) & (F.col("whole") == 1) & one_class)
    mean = lambda c: F.when(F.hypot(f"s_{c}", f"c_{c}") / F.col("group_size") >= 1e-9, F.degrees(F.atan2(f"s_{c}", f"c_{c}")))
    place = {"cent": mean, "res": lambda c: F.col(f"top.{c}"), "none": lambda c: F.lit(None).cast("double")}[how]
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in KEY], "_secondary", "group_size", place("phi").alias("phi_c"), place("psi").alias("psi_c"))
    if not spread and how != "none":
        return groups.select(*[F.col(f"_{k}").alias(k) for k in KEY], F.col("_secondary").alias("secondary"), "group_size", F.col("phi_c").alias("phi"), F.col("psi_c").alias("psi"), F.lit(None).cast("double").alias("std"))
    own = df.join(groups, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    if how == "none":
        return own.select(*KEY, F.col("_secondary").alias("secondary"), "group_size", "phi", "psi")
    d2 = angles.torus_distance("phi", "psi", "phi_c", "psi_c", squared=True)
    # the members share their group's values; avg and max of numbers need no list of members
    out = own.groupBy(*KEY, F.col("_secondary").alias("secondary"), "group_size").agg(F.max("phi_c").alias("phi"), F.max("psi_c").alias("psi"), F.sqrt(F.avg(d2)).alias("std"))
    return out.select(*KEY, "secondary", "group_size", "phi", "psi", "std")


def group_sizes(df: DataFrame, condition: str = "secondary") -> DataFrame:
    """Distinct residues by condition, by condition and amino acid, and by condition and codon; level says which."""
    sets = [["c"], ["c", "aa"], ["c", "codon"]]
    df = df.select(F.col(condition).alias("c"), "aa", "codon", "unp_id", "unp_idx").distinct()
    g = df.groupingSets([[F.col(x) for x in s] for s in sets], F.col("c"), F.col("aa"), F.col("codon")).agg(F.count("*").alias("n"), F.grouping("aa").alias("ga"), F.grouping("codon").alias("gc"))
    level = F.when((F.col("ga") == 1) & (F.col("gc") == 1), "total").when(F.col("gc") == 1, "aa").otherwise("codon")
    return g.select(F.col("c").alias("condition"), level.alias("level"), F.coalesce("aa", "codon").alias("subgroup"), "n")


def groupby_with_full(df: DataFrame, by: str, aggregates: list[Column], full: str = "ANY", skip_full: bool = False) -> DataFrame:
    """Aggregates per group and, unless skipped, over all rows."""
    if skip_full:
        return df.groupBy(by).agg(*aggregates)
    g = df.rollup(by).agg(*aggregates, F.grouping(by).alias("_g"))
    return g.withColumn(by, F.when(F.col("_g") == 1, F.lit(full)).otherwise(F.col(by).cast("string"))).drop("_g")


def best_of(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def dedup_keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return best_of(df, by, *order)


def token_sets(tokens: DataFrame, key: str, gram: str) -> DataFrame:
    """Each key's distinct grams in order: key, grams."""
    return tokens.where(F.col(gram).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(gram)).alias("grams"))


#: Grams are counted by hash in so many cells, which is only where their order comes from.
CELLS = 1 << 20


def similar_sets(sets: DataFrame, counts: np.ndarray, threshold: float, rep: str, block_grams: int = 5_000_000) -> DataFrame:
    """Pairs a, b of rows whose sets of grams may have a cosine of at least the threshold t, few of them in vain; none is lost.

    Grams are ordered by the count of their cell, then by hash. A set of n keeps its first n - ceil(t * t * n) + 1. Of a
    pair with n <= m grams, at least o = ceil(t * root(n m)) are common, so those kept, p and q of them, have at least
    min(p - n, q - m) + o in common, which is 1 at least. These are counted for all pairs of two blocks at a time, by an
    index of one of them; a hash in common that is no gram in common makes the count greater only.
    """
    spark = sets.sparkSession
    held = spark.sparkContext.broadcast(counts)
    kind = dict(sets.dtypes)[rep]
    hashed = sets.select(F.col(rep).alias("rep"), F.size("grams").alias("n"), F.transform("grams", lambda x: F.xxhash64(x)).alias("h")).where("n > 0")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            n = batch["n"].to_numpy().astype(np.int64)
            h = batch["h"].flatten().to_numpy()
            row, count = np.repeat(np.arange(len(n)), n), held.value[h & (CELLS - 1)]
            order = np.lexsort((h, count, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            size = n - np.ceil(threshold * threshold * n - 1e-9).astype(np.int64) + 1
            first = order[(place < size[row]) & (count[order] > 1)]  # what occurs once is in no other set
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(n)))))
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((h[first] >> 32).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["n"], pa.array(size, pa.int32()), prefix], ["rep", "n", "p", "prefix"])

    rows = hashed.mapInArrow(kept, f"rep {kind}, n int, p int, prefix array<int>").checkpoint()

    def each(table: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        reps, n, p = table["rep"].combine_chunks(), table["n"].to_numpy().astype(np.int64), table["p"].to_numpy().astype(np.int64)
        lists = table["prefix"].combine_chunks()
        values, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        once = len(left) == len(right) and bool((left == right).all())
        flat = lambda rows: np.concatenate([values[at[i] : at[i + 1]] for i in rows]) if len(rows) else values[:0]
        owner = np.repeat(np.arange(len(right), dtype=np.int32), (at[1:] - at[:-1])[right])
        index = flat(right)
        order = np.argsort(index, kind="stable")
        index, owner = index[order], owner[order]
        gap = (p - n)[right].min() if len(right) else 0
        least = n[right].min() if len(right) else 0
        step = max(1, (1 << 21) // max(1, len(right)))
        k = 0
        while k < len(left):
            rows, grams = left[k : k + step], flat(left[k : k + step])
            mine = np.repeat(np.arange(len(rows)), (at[1:] - at[:-1])[rows])
            low = np.searchsorted(index, grams, "left")
            hits = np.searchsorted(index, grams, "right") - low
            if (total := int(hits.sum())) > 1 << 21 and len(rows) > 1:  # fewer rows at once
                step = max(1, len(rows) // 2)
                continue
            k += len(rows)
            where = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(total)
            seen = np.bincount(np.repeat(mine, hits) * len(right) + owner[where], minlength=len(rows) * len(right)).reshape(len(rows), -1)
            most = np.ceil(threshold * np.sqrt(n[rows] * np.maximum(least, np.ceil(threshold * threshold * n[rows] - 1e-9))) - 1e-9)
            x, y = np.nonzero(seen >= np.maximum(1, np.minimum((p - n)[rows], gap) + most)[:, None])
            i, j = rows[x], right[y]
            need = np.minimum((p - n)[i], (p - n)[j]) + np.ceil(threshold * np.sqrt((n[i] * n[j]).astype(float)) - 1e-9)
            good = (seen[x, y] >= np.maximum(need, 1)) & (np.minimum(n[i], n[j]) >= threshold * threshold * np.maximum(n[i], n[j]) - 1e-9)
            good &= (i < j) | (not once)
            yield pa.RecordBatch.from_arrays([reps.take(pa.array(i[good])), reps.take(pa.array(j[good]))], ["a", "b"])

    return blocks.paired(rows, "n", threshold, F.size("prefix"), block_grams, F.col("rep"), each, f"a {kind}, b {kind}")


def set_kinds(sets: DataFrame, key: str) -> DataFrame:
    """key and kind, which is the same for equal sets: their size and the SHA-256 of their grams."""
    return sets.select(key, F.struct(F.size("grams").alias("n"), F.unhex(F.sha2(F.to_json("grams"), 256)).alias("h")).alias("kind"))


def set_pairs(tokens: DataFrame, sets: DataFrame, reps: DataFrame, threshold: float, key: str, gram: str, block_grams: int) -> DataFrame:
    """a, b, shared, similarity of the pairs of ``reps``, sets that differ, with a cosine of at least the threshold.

    Those that may be similar come from ``similar_sets``; each is then counted on the grams themselves.
    """
    cells = tokens.where(F.col(gram).isNotNull()).groupBy(F.xxhash64(gram).bitwiseAND(CELLS - 1).alias("cell")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    pairs = similar_sets(sets.join(reps.select(key), key, "left_semi"), counts, threshold, key, block_grams).checkpoint()
    some = sets.join(pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct(), key, "left_semi")
    side = lambda k: some.select(F.col(key).alias(k), F.col("grams").alias(f"grams_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    both = both.select("a", "b", shared.cast("bigint").alias("shared"), (shared / F.sqrt((F.size("grams_a") * F.size("grams_b")).cast("double"))).alias("similarity"))
    return both.where(F.col("similarity") >= threshold - 1e-12)


def ngram_similarity(tokens: DataFrame, threshold: float, key: str = "doc_id", gram: str = "tok", block_grams: int = 5_000_000, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Pairs a < b of sequences whose sets of grams have a cosine of at least the threshold t (above 0).

    Equal sets are compared once (``set_pairs``). The session needs a checkpoint folder. keep: writes the sets, which are
    read several times.
    """
    sets = keep(token_sets(tokens, key, gram), "sets")
    kinds = blocks.copies(set_kinds(sets, key), key, "kind").select(F.array_min("ids").alias(key), "ids", F.col("kind.n").cast("bigint").alias("n")).checkpoint()
    found = set_pairs(tokens, sets, kinds, threshold, key, gram, block_grams)
    side = lambda k: kinds.select(F.col(key).alias(k), F.col("ids").alias(f"ids_{k}"))
    both = found.join(side("a"), "a").join(side("b"), "b").select("ids_a", "ids_b", F.lit(False).alias("same"), "shared", "similarity")
    own = kinds.where("size(ids) > 1 AND n > 0").select(F.col("ids").alias("ids_a"), F.col("ids").alias("ids_b"), F.lit(True).alias("same"), F.col("n").alias("shared"), F.lit(1.0).alias("similarity"))
    return blocks.members(both.union(own), "shared", "similarity")


def nonredundant_sets(tokens: DataFrame, threshold: float, key: str = "doc_id", gram: str = "tok", block_grams: int = 5_000_000, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """A maximal set of sequences no two of which have a cosine above the threshold (``select_nonredundant``).

    Of equal sets only the one decided first is compared with others: they have the same neighbours and itself. keep: as in
    ``ngram_similarity``.
    """
    sets = keep(token_sets(tokens, key, gram), "sets")
    least = F.min(F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k")))
    first = set_kinds(sets, key).groupBy("kind").agg(least.alias("_l")).select(F.col("_l.k").alias(key)).checkpoint()
    return select_nonredundant(first, set_pairs(tokens, sets, first, threshold, key, gram, block_grams), key, threshold)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    row = 0
    for c in b:
        x = row | where.get(c, 0)
        row = x & ~(x - (row << 1 | 1)) if x else 0
    return bin(row & ((1 << len(a)) - 1)).count("1")


def aligned_similarity(pairs: DataFrame, seq_a: str, seq_b: str) -> DataFrame:
    """Adds similarity: LCS length over the root of the product of the lengths."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(a, b) / (len(a) * len(b)) ** 0.5 if a and b else None for a, b in zip(x, y, strict=True)], dtype="float64")

    return pairs.withColumn("similarity", score(seq_a, seq_b))


def aligned_pairs(df: DataFrame, threshold: float, alphabet: list[str] | None = None, key: str = "struct_id", seq: str = "seq", block_rows: int = 2000) -> DataFrame:
    """Pairs a < b (the upper triangle) whose aligned similarity is at least the threshold t (above 0), with it.

    Equal sequences are aligned once. No alignment is longer than the shorter sequence, nor than the letters both have, so
    before any alignment a pair is ruled out by its lengths (n >= t * t * m) and by its counts of letters. Pairs are dealt
    out as pairs of blocks of about ``block_rows`` sequences (``blocks.paired``), so tasks grow with the input, and many are
    aligned at once (``lcs``). Empty and null sequences are similar to none. The letters are those found; ``alphabet`` is
    not needed any more.
    """
    own = df.where(F.length(seq) > 0).select(F.col(key).alias("id"), F.col(seq).alias("s"))
    rows = blocks.copies(own, "id", "s").withColumn("n", F.length("s"))

    def each(table: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        seqs, ids = lcs.Coded(table["s"].to_pylist()), blocks.id_lists(table)
        once = len(left) == len(right) and bool((left == right).all())

        def made(i: np.ndarray, j: np.ndarray, similarity: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(i), 10000):
                x, y = i[k : k + 10000], j[k : k + 10000]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(np.full(len(x), same)), pa.array(similarity[k : k + 10000])], ["ids_a", "ids_b", "same", "similarity"])

        if once:
            many = left[pc.list_value_length(ids).to_numpy()[left] > 1]
            yield from made(many, many, np.ones(len(many)), True)
        for i, j in lcs.candidates(seqs, left, right, threshold, once):
            similarity = lcs.lengths(seqs, i, j) / (seqs.n[i] * seqs.n[j]).astype(float) ** 0.5
            good = similarity >= threshold - 1e-12
            yield from made(i[good], j[good], similarity[good], False)

    kind = dict(own.dtypes)["id"]
    found = blocks.paired(rows, "n", threshold, F.ceil(F.col("n") / 1000), block_rows, F.struct("s", "ids"), each, f"ids_a array<{kind}>, ids_b array<{kind}>, same boolean, similarity double")
    return blocks.members(found, "similarity")


def aligned_with(df: DataFrame, reference: Column, key: str = "struct_id", seq: str = "seq", shares: int = 16) -> DataFrame:
    """The aligned similarity of every sequence with each of those that ``reference`` chooses: ref_id, key, similarity (null
    where one is empty).

    Equal sequences are aligned once. Both sides are cut into ``shares`` blocks by hash, and a task gets one of each.
    """
    kind = dict(df.dtypes)[key]
    own = blocks.copies(df.select(key, seq), key, seq).withColumn("ref", F.lit(False))
    refs = blocks.copies(df.where(reference).select(key, seq), key, seq).withColumn("ref", F.lit(True))
    block = F.pmod(F.xxhash64(seq, "ids"), F.lit(shares)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    rows = own.withColumns({"_x": block, "_y": every}).unionByName(refs.withColumns({"_y": block, "_x": every}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        seqs, ids, ref = lcs.Coded([s or "" for s in table[seq].to_pylist()]), blocks.id_lists(table), table["ref"].to_numpy()
        first, second = np.flatnonzero(ref), np.flatnonzero(~ref)
        step = max(1, (1 << 20) // max(1, len(second)))
        for k in range(0, len(first), step):
            i, j = np.repeat(first[k : k + step], len(second)), np.tile(second, len(first[k : k + step]))
            size = (seqs.n[i] * seqs.n[j]).astype(float) ** 0.5
            similarity = lcs.lengths(seqs, i, j) / np.maximum(size, 1e-9)
            for at in range(0, len(i), 10000):
                x, y, z = i[at : at + 10000], j[at : at + 10000], similarity[at : at + 10000]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(z, mask=size[at : at + 10000] == 0)], ["refs", "ids", "similarity"])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    both = rows.groupBy("_x", "_y").applyInArrow(run, f"refs array<{kind}>, ids array<{kind}>, similarity double")
    return both.withColumn("ref_id", F.explode("refs")).select("ref_id", F.explode("ids").alias(key), "similarity")


def first_of_equal(sequences: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Of equal sequences the one that ``select_nonredundant`` decides first; empty and null ones are left out. The others of
    its kind have the same neighbours and itself, so none of them is ever kept."""
    least = F.min(F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k")))
    return sequences.where(F.length(seq) > 0).groupBy(seq).agg(least.alias("_l")).select(F.col("_l.k").alias(key), seq)


def select_nonredundant(nodes: DataFrame, similar: DataFrame, key: str = "id", threshold: float = 0.7) -> DataFrame:
    """A maximal set of nodes no two of which have a similarity above the threshold.

    Rounds: a node whose priority (hash, then id) is the least among its undecided neighbours is kept and its neighbours
    are dropped; after an expected O(log n) rounds all are decided.
    """
    edges = similar.where(F.col("similarity") > threshold).select("a", "b")
    edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    lonely = nodes.select(key).distinct().join(edges, nodes[key] == edges["a"], "left_anti")
    kept = lonely
    while not edges.isEmpty():
        least = edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
        chosen = least.where(rank("a") < F.col("m")).select(F.col("a").alias(key)).checkpoint()
        gone = edges.join(chosen, edges["a"] == chosen[key]).select(F.col("b").alias("x")).union(chosen.select(key)).distinct()
        left = edges.join(gone, edges["a"] == gone["x"], "left_anti").join(gone, edges["b"] == gone["x"], "left_anti")
        undecided = edges.select("a").distinct().join(gone, F.col("a") == gone["x"], "left_anti")
        edges = left.checkpoint()
        alone = undecided.join(edges, "a", "left_anti").select(F.col("a").alias(key))
        kept = kept.union(chosen).union(alone).checkpoint()
    return kept
