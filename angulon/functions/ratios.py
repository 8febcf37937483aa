"""Ratios with error propagation, and interval estimates of proportions, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _relative(x: Column, sx: Column) -> Column:
    return F.pow(F.coalesce(F.nanvl(sx, F.lit(0.0)), F.lit(0.0)) / x, F.lit(2))


def ratio(x: Column, sx: Column, y: Column, sy: Column) -> tuple[Column, Column]:
    """x / y and its deviation; missing deviations count as 0."""
    r = x / F.nullif(y, F.lit(0.0))
    return r, F.abs(r) * F.sqrt(_relative(x, sx) + _relative(y, sy))


def product(x: Column, sx: Column, y: Column, sy: Column) -> tuple[Column, Column]:
    r = x * y
    return r, F.abs(r) * F.sqrt(_relative(x, sx) + _relative(y, sy))


#: Terms of the series and levels of the continued fraction of the normal distribution function; where they meet.
SERIES, LEVELS, MEET = 40, 40, 3


def _norm_tail(z, density):
    """Upper tail of z >= MEET: density / (z + 1 / (z + 2 / (z + ...)))."""
    below = z
    for k in range(LEVELS, 0, -1):
        below = z + k / below
    return density / below


def _norm_half(z, density):
    """What lies between 0 and z of -MEET < z < MEET: density (z + z^3 / 3 + z^5 / 15 + ...)."""
    total = 1.0
    for k in range(SERIES, 0, -1):
        total = 1.0 + z * z / (2 * k + 1) * total
    return density * z * total


def norm_cdf(z: Column) -> Column:
    """The normal distribution function to double precision, in generated code; tails keep their relative precision."""
    density = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    far = _norm_tail(F.abs(z), density)
    return F.when(z >= MEET, 1.0 - far).when(z <= -MEET, far).otherwise(0.5 + _norm_half(z, density))


def norm_cdf_sql(z: str) -> str:
    """The same as SQL; ``z`` is the name of a double."""
    density, below, total = f"(exp(-0.5::DOUBLE*{z}*{z})/{math.sqrt(2 * math.pi)!r}::DOUBLE)", f"abs({z})", "1.0::DOUBLE"
    for k in range(LEVELS, 0, -1):
        below = f"(abs({z})+{k}/{below})"
    for k in range(SERIES, 0, -1):
        total = f"(1.0::DOUBLE+{z}*{z}/{2 * k + 1}*{total})"
    return f"CASE WHEN {z}>={MEET} THEN 1-{density}/{below} WHEN {z}<=-{MEET} THEN {density}/{below} ELSE 0.5+{density}*{z}*{total} END"


def proportion_interval(k: Column, n: Column, z: float, method: str = "wilson") -> tuple[Column, Column]:
    """Lower and upper bound of a proportion: normal, wilson, or wilson_cc (continuity corrected)."""
    p = k / n
    if method == "normal":
        half = z * F.sqrt(p * (1 - p) / n)
        lo, hi = p - half, p + half
    elif method == "wilson":
        mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        lo, hi = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    elif method == "wilson_cc":
        base = 2 * n * p + z * z
        root = lambda s: z * F.sqrt(F.greatest(z * z - 1 / n + 4 * n * p * (1 - p) + s * (4 * p - 2), F.lit(0.0))) + 1
        lo = F.when(k == 0, F.lit(0.0)).otherwise((base - root(1)) / (2 * (n + z * z)))
        hi = F.when(k == n, F.lit(1.0)).otherwise((base + root(-1)) / (2 * (n + z * z)))
    else:
        raise ValueError(method)
    return F.greatest(lo, F.lit(0.0)), F.least(hi, F.lit(1.0))


def none_seen_bound(n: Column, alpha: float) -> Column:
    """Upper bound of a proportion never seen in n trials: -ln(alpha) / n (3 / n for 0.05)."""
    return F.least(F.lit(-math.log(alpha)) / n, F.lit(1.0))
