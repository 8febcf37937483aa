"""Angles on the circle and the torus, as Column expressions. Degrees unless stated; null in, null out."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Resultants shorter than this (as a share of the members) have no direction.
NO_DIRECTION = 1e-9


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrap(a: Column | str) -> Column:
    """Radians brought to [-pi, pi]; values already there are left as they are."""
    a = _col(a)
    return F.when(F.abs(a) > pi, F.atan2(F.sin(a), F.cos(a))).otherwise(a)


def wraparound_diff(a: Column | str, b: Column | str, degrees: bool = True) -> Column:
    """The arc between two angles."""
    d = F.abs(_col(a) - _col(b))
    return F.least(d, F.lit(360.0 if degrees else 2 * pi) - d)


def torus_distance(phi1, psi1, phi2, psi2, degrees: bool = True, squared: bool = False) -> Column:
    """Flat-torus distance; squared gives squared degrees (or radians)."""
    d2 = F.pow(wraparound_diff(phi1, phi2, degrees), F.lit(2)) + F.pow(wraparound_diff(psi1, psi2, degrees), F.lit(2))
    return d2 if squared else F.sqrt(d2)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    g = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(g(1, 2), g(2, 0), g(0, 1))


def scaled(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def unit(a: Column) -> Column:
    return scaled(a, 1 / F.sqrt(dot(a, a)))


def dihedral(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """The torsion about p2-p3, radians; points are arrays of three numbers."""
    b1, b2, b3 = minus(p2, p1), minus(p3, p2), minus(p4, p3)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(dot(scaled(b1, F.sqrt(dot(b2, b2))), n2), dot(n1, n2))


def exact_sum(x: Column) -> Column:
    """Aggregate: the sum of numbers within [-1, 1], each to 2**-64, the same whatever their order; at most 2**31 rows.

    Sines that cancel add up to 0, not to a remainder whose sign depends on the order: at 180 degrees the sign of the
    mean is that of this sum.
    """
    high = (x * 2.0**32).try_cast("bigint")
    low = ((x * 2.0**32 - high) * 2.0**32).try_cast("bigint")
    high, low = F.sum(high), F.sum(low)
    carry = F.shiftright(low, 32)
    total = (high + carry) / F.lit(2.0**32) + (low - F.shiftleft(carry, 32)) / F.lit(2.0**64)
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(total)


def _mean_parts(a: Column | str) -> tuple[Column, Column]:
    r = F.radians(_col(a))
    return F.avg(F.sin(r)), F.avg(F.cos(r))


def circ_mean(a: Column | str) -> Column:
    """Aggregate: direction of the mean of unit vectors. Nulls are skipped; without a direction null."""
    r = F.radians(_col(a))
    s, c = exact_sum(F.sin(r)), exact_sum(F.cos(r))
    return F.when(F.hypot(s, c) / F.count(_col(a)) > NO_DIRECTION, F.degrees(F.atan2(s, c)))


def circ_std(a: Column | str) -> Column:
    """Aggregate: sqrt(-2 ln R), degrees; 0 for a single value, null without values or direction."""
    s, c = _mean_parts(a)
    r = F.least(F.hypot(s, c), F.lit(1.0))
    return F.when(F.count(_col(a)) == 1, F.lit(0.0)).when(r > NO_DIRECTION, F.degrees(F.sqrt(-2 * F.log(r))))


def circ_centroid(phi: str, psi: str) -> list[Column]:
    """Aggregates phi, psi and their standard deviations."""
    return [circ_mean(phi).alias(phi), circ_mean(psi).alias(psi), circ_std(phi).alias(f"{phi}_std"), circ_std(psi).alias(f"{psi}_std")]


def frechet_axis(df: DataFrame, by: list[str], angle: str, out: str, arcs: int = 1024) -> DataFrame:
    """Per group the point with the least mean squared arc to the members, and the root of that. Degrees from -180 on.

    With the members sorted, the minimiser is the mean after moving the first k of them once around, for some k; each
    candidate's cost follows from prefix sums. These come in two levels: sums of arcs, of which a group has ``arcs`` at
    most, and within an arc over its distinct angles; so no window holds more than an arc. Equal costs: least absolute
    value, then the lesser.
    """
    own = df.where(F.col(angle).isNotNull()).groupBy(*by, F.col(angle).cast("double").alias("_x")).agg(F.count("*").alias("_w"))
    own = own.withColumn("_arc", F.floor((F.col("_x") + 180.0) * (arcs / 360.0)))
    x, w = F.col("_x"), F.col("_w")
    sums = own.groupBy(*by, "_arc").agg(F.sum("_w").alias("_n"), F.sum(x * w).alias("_s"), F.sum(x * x * w).alias("_q"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_arc").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_s")]
    sums = sums.select(*[F.col(c).alias(f"_{c}_of") for c in by], F.col("_arc").alias("_arc_of"), *before, *[F.sum(c).over(group).alias(f"{c}_all") for c in ("_n", "_s", "_q")])
    both = own.join(sums, [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in by] + [F.col("_arc") == F.col("_arc_of")])
    here = Window.partitionBy(*by, "_arc").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("_n_before") + F.coalesce(F.sum("_w").over(here), F.lit(0))
    moved = F.col("_s_before") + F.coalesce(F.sum(x * w).over(here), F.lit(0.0))
    n = F.col("_n_all")
    mean = (F.col("_s_all") + 360.0 * k) / n
    cost = (F.col("_q_all") + 720.0 * moved + 129600.0 * k) / n - mean * mean
    wrapped = mean - 360.0 * F.floor((mean + 180.0) / 360.0)
    rows = both.select(*by, F.round(F.greatest(cost, F.lit(0.0)), 9).alias("_c"), F.round(wrapped, 9).alias("_m"))
    best = rows.groupBy(*by).agg(F.min(F.struct("_c", F.abs("_m").alias("_a"), "_m")).alias("_b"))
    return best.select(*by, F.col("_b._m").alias(out), F.sqrt("_b._c").alias(f"{out}_std"))


def frechet_centroid(df: DataFrame, by: list[str], phi: str = "phi", psi: str = "psi") -> DataFrame:
    """Frechet means and deviations of both axes."""
    parts = [frechet_axis(df, by, a, a) for a in (phi, psi)]
    return reduce(lambda x, y: x.join(y, by), parts)


def cross_bond(df: DataFrame, order: Window) -> DataFrame:
    """Angles about a bond between neighbours: phi of the next, psi and omega of this one."""
    return df.withColumns({"phi_next": F.lead("phi").over(order), "psi_here": F.col("psi"), "omega_here": F.col("omega")})


def location_sigma(b: Column | str) -> Column:
    """sqrt(B / 8 pi^2); null for negative B."""
    b = _col(b)
    return F.when(b >= 0, F.sqrt(b / (8 * pi * pi)))
