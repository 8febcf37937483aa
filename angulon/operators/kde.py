"""Densities on a grid of the torus. Cell i stands for the angle -180 + 360 i / bins; the upper end is left out."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles


def raw_weights(angle: str, bins: int, sigma: float) -> list[Column]:
    """A sample's Gaussian weights (sigma in degrees) at the cells of one axis."""
    gaps = [angles.wraparound_diff(F.col(angle), F.lit(-180.0 + 360.0 / bins * i)) / sigma for i in range(bins)]
    return [F.exp(-0.5 * g * g) for g in gaps]


def spread(df: DataFrame, by: list[str], bins: int, sigma: float, phi: str = "phi", psi: str = "psi") -> DataFrame:
    """by, i, x, y0, y1, ...: for each sample and cell i of the first axis its weight there and those of the second axis.

    The weights of an axis sum to 1. Each is a scalar, so all of it is one span of generated code.
    """
    df = df.where(F.col(phi).isNotNull() & F.col(psi).isNotNull()).select(*by, F.col(phi).alias("_phi"), F.col(psi).alias("_psi"))
    raw = df.select(*by, *[w.alias(f"_{a}{i}") for a in ("phi", "psi") for i, w in enumerate(raw_weights(f"_{a}", bins, sigma))])
    total = raw.withColumns({f"_{a}_t": reduce(add, [F.col(f"_{a}{i}") for i in range(bins)]) for a in ("phi", "psi")})
    share = lambda a, i: F.col(f"_{a}{i}") / F.col(f"_{a}_t")
    return total.select(*by, F.posexplode(F.array(*[share("phi", i) for i in range(bins)])).alias("i", "x"), *[share("psi", j).alias(f"y{j}") for j in range(bins)])


def kde_grid(df: DataFrame, by: list[str], bins: int = 16, sigma: float = 30.0, phi: str = "phi", psi: str = "psi") -> DataFrame:
    """by, i, j, p: the mean over the samples of the kernel, normalised for each; a torus Gaussian, separable in the axes."""
    sums = spread(df, by, bins, sigma, phi, psi).groupBy(*by, "i").agg(*[F.avg(F.col("x") * F.col(f"y{j}")).alias(f"c{j}") for j in range(bins)])
    return sums.select(*by, F.col("i").cast("int").alias("i"), F.posexplode(F.array(*[f"c{j}" for j in range(bins)])).alias("j", "p"))


def von_mises_grid(df: DataFrame, by: list[str], bins: int, k1: float, k2: float, k3: float = 0.0) -> DataFrame:
    """As kde_grid with the bivariate von Mises cosine kernel exp(k1 cos x + k2 cos y + k3 cos(x - y)), not separable.

    A sample's total over the grid is one value of its row; nothing but partial averages is exchanged.
    """
    at = lambda i: F.radians(F.lit(360.0 / bins) * i - 180.0)
    kernel = lambda x, y: F.exp(k1 * F.cos(x) + k2 * F.cos(y) + k3 * F.cos(x - y))
    steps = F.sequence(F.lit(0), F.lit(bins - 1))
    df = df.where("phi IS NOT NULL AND psi IS NOT NULL").select(*by, F.radians("phi").alias("_x"), F.radians("psi").alias("_y"))
    line = lambda i: F.aggregate(steps, F.lit(0.0), lambda s, j: s + kernel(F.col("_x") - at(i), F.col("_y") - at(j)))
    rows = df.withColumn("_t", F.aggregate(steps, F.lit(0.0), lambda s, i: s + line(i))).select(*by, "_x", "_y", "_t", F.explode(steps).alias("i"))
    sums = rows.groupBy(*by, "i").agg(*[F.avg(kernel(F.col("_x") - at(F.col("i")), F.col("_y") - at(F.lit(j))) / F.col("_t")).alias(f"c{j}") for j in range(bins)])
    return sums.select(*by, "i", F.posexplode(F.array(*[f"c{j}" for j in range(bins)])).alias("j", "p"))


def grid_l2(a: DataFrame, b: DataFrame) -> DataFrame:
    """Squared L2 distance of two densities (i, j, p); missing cells are 0."""
    both = a.select("i", "j", F.col("p").alias("pa")).join(b.select("i", "j", F.col("p").alias("pb")), ["i", "j"], "full")
    gap = F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))
    return both.agg(F.sum(gap * gap).alias("l2"))
