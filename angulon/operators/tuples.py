"""Tuples of consecutive residues, likelihoods, and codon-tuple frequencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashes, ratios


def build_tuples(df: DataFrame, k: int = 2) -> DataFrame:
    """Rows i..i+k-1 of a protein with consecutive positions and one secondary structure: psi of the first, phi of the
    last, least group size, greatest std, names joined. Several rows at a position are ordered by structure and codon."""
    order = Window.partitionBy("unp_id").orderBy("unp_idx", "secondary", "codon")
    for j in range(1, k):
        for c in ("unp_idx", "secondary", "codon", "phi", "group_size", "std"):
            df = df.withColumn(f"{c}_{j}", F.lead(c, j).over(order))
    ok = [(F.col(f"unp_idx_{j}") == F.col("unp_idx") + j) & (F.col(f"secondary_{j}") == F.col("secondary")) for j in range(1, k)]
    df = df.where(reduce(Column.__and__, ok)) if ok else df
    later = lambda c: [F.col(c), *(F.col(f"{c}_{j}") for j in range(1, k))]
    least = lambda f, c: f(*later(c)) if k > 1 else F.col(c)
    last = f"phi_{k - 1}" if k > 1 else "phi"
    return df.select("unp_id", "unp_idx", "secondary", F.concat_ws("_", *later("codon")).alias("codon"), F.col(last).alias("phi"), "psi", least(F.least, "group_size").alias("group_size"), least(F.greatest, "std").alias("std"))


def codon_tuples(df: DataFrame, k: int = 2, ss: list[str] | None = None) -> DataFrame:
    """Tuples of k consecutive unambiguous codons, of the allowed structures: one for each protein and start."""
    df = df.where(F.col("codon_score") == 1)
    df = df.where(F.col("secondary").isin(ss)) if ss else df
    one = df.withColumn("_r", F.row_number().over(Window.partitionBy("unp_id", "unp_idx").orderBy("codon", "secondary"))).where("_r = 1")
    order = Window.partitionBy("unp_id").orderBy("unp_idx")
    for j in range(1, k):
        one = one.withColumn(f"_i{j}", F.lead("unp_idx", j).over(order)).withColumn(f"_c{j}", F.lead("codon", j).over(order))
    for j in range(1, k):
        one = one.where(F.col(f"_i{j}") == F.col("unp_idx") + j)
    return one.select("unp_id", "unp_idx", F.array("codon", *[f"_c{j}" for j in range(1, k)]).alias("codons"))


def likelihoods(df: DataFrame, universe: DataFrame, column: str = "codon", condition: str = "secondary") -> DataFrame:
    """P(value | condition) for every value of ``universe`` and condition, P(condition), and the mixture ANY."""
    n = df.groupBy(F.col(condition).alias("condition"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = n.groupBy("condition").agg(F.sum("n").alias("total"))
    total = total.withColumn("p_condition", F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    grid = total.crossJoin(F.broadcast(universe.select(F.col(universe.columns[0]).alias("value"))))  # conditions x values, both few
    each = grid.join(n, ["condition", "value"], "left").select("condition", "value", "p_condition", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))
    mixture = each.groupBy("value").agg(F.sum(F.col("p_condition") * F.col("p")).alias("p")).select(F.lit("ANY").alias("condition"), "value", F.lit(1.0).alias("p_condition"), "p")
    return each.union(mixture)


def histogram(df: DataFrame, column: str, edges: list[float], normalized: bool = True) -> DataFrame:
    """bin, count and share of the values within the bins; the last bin holds its upper edge."""
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    last, x = len(edges) - 2, F.col(column)
    at = reduce(lambda w, i: w.when((x >= edges[i]) & ((x < edges[i + 1]) if i < last else (x <= edges[i + 1])), i), range(last + 1), F)
    n = df.select(at.cast("int").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    out = bins.join(n, "bin", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return out.select("bin", "lo", "hi", "n", (F.col("n") / F.nullif(total, F.lit(0)) if normalized else F.col("n").cast("double")).alias("p"))


def bootstrap_histogram(df: DataFrame, column: str, key: list[str], bootstraps: int, seed: int = 1) -> DataFrame:
    """Mean and deviation of each value's share over resamples: every row enters each one a Poisson(1) number of times.

    The number comes from one of the row's key (integers or strings) that any engine can repeat; counts are summed before
    the exchange.
    """
    bounds = []
    p, total = 0.36787944117144233, 0.0
    for i in range(1, 9):
        total += p
        bounds.append(total)
        p /= i
    rows = df.select(F.col(column).alias("value"), hashes.number(seed, *key).alias("h")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(bootstraps))))
    u = hashes.turned(F.col("h") + F.col("b") * 7919) / float(hashes.PRIME)
    rows = rows.withColumn("u", u).withColumn("w", reduce(lambda a, b: a + b, [(F.col("u") > x).cast("int") for x in bounds]))
    n = rows.groupBy("b", "value").agg(F.sum("w").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("b")))
    sums = n.groupBy("value").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2"))
    mean = F.col("s") / bootstraps
    return sums.select("value", mean.alias("p"), F.sqrt(F.greatest(F.col("s2") / bootstraps - mean * mean, F.lit(0.0))).alias("std"))


def relative_histogram(hist: DataFrame, parent: Column) -> DataFrame:
    """p(value | parent): value, p, std of ``hist`` over the sums for what ``parent`` maps values to."""
    h = hist.withColumn("parent", parent)
    up = h.groupBy("parent").agg(F.sum("p").alias("pp"), F.sqrt(F.sum(F.col("std") * F.col("std"))).alias("ps"))
    h = h.join(up, "parent")
    r, s = ratios.ratio(F.col("p"), F.col("std"), F.col("pp"), F.col("ps"))
    return h.select("parent", "value", r.alias("p"), s.alias("std"))


def product_histogram(hist: DataFrame, k: int) -> DataFrame:
    """Probabilities of k independent draws, by tuple of values; the table of values must be small."""
    out = hist.select(F.col("value").alias("value"), "p", "std")
    for _ in range(k - 1):
        nxt = F.broadcast(hist.select(F.col("value").alias("v2"), F.col("p").alias("p2"), F.col("std").alias("s2")))
        both = out.crossJoin(nxt)
        p, s = ratios.product(F.col("p"), F.col("std"), F.col("p2"), F.col("s2"))
        out = both.select(F.concat_ws("_", "value", "v2").alias("value"), p.alias("p"), s.alias("std"))
    return out


def tuple_grid(tuples: DataFrame, aa_of, k: int) -> DataFrame:
    """Per tuple of k codons that occur, seen or not, whose amino acids' tuple occurs: counts, share, and the product of
    the places' shares. The codons (at most 64) are read off the tuples."""
    t = tuples.select("codons", F.transform("codons", aa_of).alias("aas"))
    seen = t.groupBy("codons", "aas").agg(F.count("*").alias("n_cc"))
    n_aa = seen.groupBy("aas").agg(F.sum("n_cc").alias("n_aa"))
    places = seen.select("aas", "n_cc", F.posexplode("codons").alias("place", "codon")).groupBy("aas", "place", "codon").agg(F.sum("n_cc").alias("n"))
    universe = places.select("codon").distinct().select("codon", aa_of(F.col("codon")).alias("aa"))
    grid = n_aa.withColumn("codons", F.array().cast("array<string>")).withColumn("p_ind", F.lit(1.0))
    for i in range(k):
        own = places.where(F.col("place") == i).select("aas", "codon", "n")
        grid = grid.withColumn("aa", F.get("aas", F.lit(i))).join(universe, "aa").join(own, ["aas", "codon"], "left")
        grid = grid.select("aas", "n_aa", F.array_append("codons", F.col("codon")).alias("codons"), (F.col("p_ind") * F.coalesce("n", F.lit(0)) / F.col("n_aa")).alias("p_ind"))
    done = grid.join(seen, ["aas", "codons"], "left").withColumn("n_cc", F.coalesce("n_cc", F.lit(0)).cast("bigint"))
    return done.select(F.array_join("codons", "_").alias("codons"), F.array_join("aas", "_").alias("aas"), "n_aa", "n_cc", (F.col("n_cc") / F.col("n_aa")).alias("p_cc"), "p_ind")


def tuple_freq(tuples: DataFrame, aa_of) -> DataFrame:
    """Per codon tuple seen: its count, its amino acids' count, the conditional share, the product of the places' shares,
    their ratio, and z by score and by Wald. tuples: arrays ``codons``; aa_of: Column of a codon to Column of an acid."""
    t = tuples.select("codons", F.transform("codons", aa_of).alias("aas"))
    pairs = t.groupBy("codons", "aas").agg(F.count("*").alias("n_cc"))
    n_aa = F.sum("n_cc").over(Window.partitionBy("aas"))
    pairs = pairs.withColumn("n_aa", n_aa)
    places = pairs.select("codons", "aas", "n_cc", "n_aa", F.posexplode("codons").alias("place", "codon"))
    share = F.sum("n_cc").over(Window.partitionBy("aas", "place", "codon")) / F.col("n_aa")
    expected = places.withColumn("share", share).groupBy("codons", "aas", "n_cc", "n_aa").agg(F.exp(F.sum(F.log("share"))).alias("p_ind"))
    p, q, n = F.col("n_cc") / F.col("n_aa"), F.col("p_ind"), F.col("n_aa")
    score, wald = F.sqrt(q * (1 - q) / n), F.sqrt(p * (1 - p) / n)
    z = lambda s: F.when(s > 1e-9, (p - q) / s)
    return expected.select(F.array_join("codons", "_").alias("codons"), F.array_join("aas", "_").alias("aas"), "n_aa", "n_cc", p.alias("p_cc"), q.alias("p_ind"), (p / q).alias("ratio"), z(score).alias("z_score"), z(wald).alias("z_wald"))
