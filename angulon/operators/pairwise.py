"""Distances between codons from match pairs, their correction, and comparisons of distance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles, hashes


def condition_group(types: str, ss_ref: str, ss: str, options: str) -> Column:
    """The structure class a pair is compared under: both sides have it, the match is SAME or SILENT and the codon has no
    alternatives; else null."""
    ok = F.col(types).isin("SAME", "SILENT") & (F.coalesce(F.size(options), F.lit(0)) <= 1) & (F.col(ss_ref) == F.col(ss))
    return F.when(ok, F.col(ss))


def codon_pair_d2(matches: DataFrame, samples: int = 0, seed: int = 1, key: tuple[str, ...] = ("unp_id", "unp_idx", "condition", "codon1", "codon2")) -> DataFrame:
    """Per condition and unordered pair of codons the mean and deviation of the squared torus distance (squared degrees).

    matches: condition, codon1, codon2, phis1, psis1, phis2, psis2 (arrays). Each match weighs the same. samples = 0
    takes all pairs of members of a match; else that many draws of one member of each side, by numbers of the match's key
    (columns of integers and strings) that any engine can repeat.
    """
    m = matches.select(*[F.col(c).alias(f"_{c}") for c in (key if samples else ())], "condition", F.least("codon1", "codon2").alias("c1"), F.greatest("codon1", "codon2").alias("c2"), F.arrays_zip(F.col("phis1").alias("phi"), F.col("psis1").alias("psi")).alias("m1"), F.arrays_zip(F.col("phis2").alias("phi"), F.col("psis2").alias("psi")).alias("m2"))
    m = m.where((F.size("m1") > 0) & (F.size("m2") > 0))
    if samples:
        draw = lambda a, side: F.element_at(a, (hashes.number(seed, *[f"_{c}" for c in key], "b", side) % F.size(a) + 1).cast("int"))
        rows = m.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        rows = rows.withColumns({"x": draw("m1", 1), "y": draw("m2", 2)})
        d2 = angles.torus_distance("x.phi", "x.psi", "y.phi", "y.psi", squared=True)
        means = rows.groupBy("condition", "c1", "c2", "b").agg(F.avg(d2).alias("d2"))
        return means.groupBy("condition", "c1", "c2").agg(F.avg("d2").alias("d2_mean"), F.stddev_pop("d2").alias("d2_std"))
    inner = F.flatten(F.transform("m1", lambda x: F.transform("m2", lambda y: angles.torus_distance(x["phi"], x["psi"], y["phi"], y["psi"], squared=True))))
    own = F.aggregate(inner, F.lit(0.0), lambda s, v: s + v) / F.size(inner)
    return m.withColumn("d2", own).groupBy("condition", "c1", "c2").agg(F.avg("d2").alias("d2_mean"), F.stddev_pop("d2").alias("d2_std"), F.count("*").alias("n"))


def _diagonal(d: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    own = d.where("c1 = c2")
    return own.select("condition", "c1", F.col(value).alias("own1")), own.select("condition", F.col("c1").alias("c2"), F.col(value).alias("own2"))


def corrected(d: DataFrame, value: str = "d2_mean") -> DataFrame:
    """Adds delta: the distance less the mean of both codons' own."""
    a, b = _diagonal(d, value)
    return d.join(a, ["condition", "c1"]).join(b, ["condition", "c2"]).withColumn("delta", F.col(value) - (F.col("own1") + F.col("own2")) / 2)


def normalised(d: DataFrame, value: str = "d2_mean") -> DataFrame:
    """Adds norm: the distance over the geometric mean of both codons' own."""
    a, b = _diagonal(d, value)
    return d.join(a, ["condition", "c1"]).join(b, ["condition", "c2"]).withColumn("norm", F.col(value) / (F.sqrt(F.col("own1") * F.col("own2")) + 1e-12))


def correlation(x: DataFrame, y: DataFrame, aa1: Column, aa2: Column, value: str = "d2_mean") -> DataFrame:
    """Correlation of two distance tables (condition, c1, c2, value) over the synonymous pairs: of each amino acid, and of
    all of them (ALL). A single pair has none."""
    both = x.select("condition", "c1", "c2", F.col(value).alias("x")).join(y.select("condition", "c1", "c2", F.col(value).alias("y")), ["condition", "c1", "c2"])
    both = both.withColumn("aa", aa1).where(aa1 == aa2)
    r = F.when(F.count("*") > 1, F.corr("x", "y"))
    each = both.groupBy("condition", "aa").agg(F.count("*").alias("n"), r.alias("r"))
    return each.union(both.groupBy("condition").agg(F.count("*").alias("n"), r.alias("r")).select("condition", F.lit("ALL").alias("aa"), "n", "r"))


def linear_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R2 of y on x after both are scaled to [0, 1] within the group."""
    ends = df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{k}") for k, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))])
    scale = lambda c, k: ((F.col(c) - F.col(f"_lo_{k}")) / F.nullif(F.col(f"_hi_{k}") - F.col(f"_lo_{k}"), F.lit(0.0))).alias(k)
    s = df.join(ends, by).select(*by, scale(x, "x"), scale(y, "y"))
    return s.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
