"""Two-sample statistics on the torus, planned over pairs of subgroups, and permutation tests.

Members are rows (condition, subgroup, phi, psi); pairs are rows (condition, s1, s2, ...). Statistics take all members:
sums over pairs of members come from moments, Fourier sums or ranks. Tests draw their resamples from all members, by
numbers that any engine can repeat (functions/hashes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, hashes
from .kde import kde_grid
from .ranks import hash_rank


def pair_plan(sizes: DataFrame, kind: str, n_min: int = 1, n_max: int | None = None, n_max_aa: int | None = None, self_test: bool = True) -> DataFrame:
    """Subgroup pairs to compare, with the cap on their samples. sizes: condition, aa, codon, n.

    kind: ``aa`` (amino acids among themselves), ``aac`` (each codon against its amino acid), ``cc`` (synonymous codons).
    The pairs come from the list of subgroups, never from their members. The cap of aa is n_max; with n_max_aa, that of
    aac and cc is the least codon of the acid in the condition, at least 2 and at most n_max; without, it is the lesser
    of the sizes, at most n_max, if n_max is given. Tuples of acids (joined by _) are compared among those with the same
    first acid. Without self_test no subgroup is compared with itself.
    """
    acids = sizes.groupBy("condition", "aa").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    fine = sizes.select("condition", "aa", F.col("codon").alias("s"), "n")
    least = acids.select("condition", "aa", "least", F.col("n").alias("n_aa"))
    big = F.col("n1").cast("bigint") >= n_min
    if kind == "aa":
        a = acids.select("condition", F.col("aa").alias("s1"), F.col("n").alias("n1"))
        b = acids.select("condition", F.col("aa").alias("s2"), F.col("n").alias("n2"))
        first = lambda c: F.split_part(c, F.lit("_"), F.lit(1))
        alike = ~F.col("s1").contains("_") | (first("s1") == first("s2"))
        out = a.join(b, "condition").where((F.col("s1") <= F.col("s2")) & big & (F.col("n2") >= n_min) & alike)
        out = out if self_test else out.where("s1 <> s2")
        return out.select("condition", "s1", "s2", "n1", "n2", F.lit(n_max).cast("bigint").alias("cap"))
    if kind == "aac":
        out = fine.join(least, ["condition", "aa"]).select("condition", "least", F.col("aa").alias("s1"), F.col("s").alias("s2"), F.col("n_aa").alias("n1"), F.col("n").alias("n2"))
    elif kind == "cc":
        a, b = fine.toDF("condition", "aa", "s1", "n1"), fine.toDF("condition", "aa", "s2", "n2")
        out = a.join(b, ["condition", "aa"]).where("s1 <= s2" if self_test else "s1 < s2").join(least, ["condition", "aa"])
    else:
        raise ValueError(kind)
    top = F.lit(n_max).cast("bigint")
    if n_max_aa is not None:
        cap = F.least(F.greatest("least", F.lit(2)), top)
    else:
        cap = F.least("n1", "n2", top) if n_max is not None else top
    return out.where(big & (F.col("n2") >= n_min)).select("condition", "s1", "s2", "n1", "n2", cap.alias("cap"))


def _sides(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """Members of both sides of each pair: side 1 or 2."""
    key = ["condition", "s1", "s2"]
    both = pairs.select(*key, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("s1").alias("subgroup")), F.struct(F.lit(2).alias("side"), F.col("s2").alias("subgroup")))).alias("x"))
    return both.select(*key, "x.*").join(sample, ["condition", "subgroup"])


#: Arcs that torus_sums cuts an axis into; even.
ARCS = 72


def torus_sums(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Per pair n1, n2 and the sums of the squared torus distance (squared degrees) within each side (each pair of
    members once) and between, over all members, without listing their pairs.

    The distance is a sum over the axes. Each is cut into ARCS arcs; for members of two arcs that are not opposite, it
    is known which way round is shorter, so the sum follows from the arcs' counts and moments. Members of opposite arcs
    are summed up as if the way up were shorter; where it exceeds 180 by x, that is 720 x too much, and these excesses
    are sums over the order within the two arcs.
    """
    width, half = 360.0 / ARCS, ARCS // 2
    axes = members.select("condition", "subgroup", F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.pmod(F.col(c).cast("double") + 180.0, F.lit(360.0)).alias("u")) for k, c in enumerate(("phi", "psi"))])).alias("x"))
    axes = axes.select("condition", "subgroup", "x.axis", F.least(F.floor(F.col("x.u") / width), F.lit(ARCS - 1)).cast("int").alias("arc"), "x.u").withColumn("e", F.col("u") - F.col("arc") * width).drop("u")
    moments = axes.groupBy("condition", "subgroup", "axis", "arc").agg(F.count("*").alias("n"), F.sum("e").alias("e1"), F.sum(F.col("e") * F.col("e")).alias("e2"))
    wanted = pairs.select("condition", "s1", "s2")
    every = wanted.union(wanted.select("condition", "s1", "s1")).union(wanted.select("condition", "s2", "s2")).distinct()
    key = ["condition", "s1", "s2"]
    one = every.join(moments.select("condition", F.col("subgroup").alias("s1"), "axis", *[F.col(c).alias(f"{c}_a") for c in ("arc", "n", "e1", "e2")]), ["condition", "s1"])
    both = one.join(moments.select("condition", F.col("subgroup").alias("s2"), "axis", *[F.col(c).alias(f"{c}_b") for c in ("arc", "n", "e1", "e2")]), ["condition", "s2", "axis"])
    up = F.pmod(F.col("arc_b") - F.col("arc_a"), F.lit(ARCS))
    way = F.when(up > half, up - ARCS).otherwise(up) * width
    smooth = F.col("n_a") * F.col("n_b") * way * way + 2 * way * (F.col("n_a") * F.col("e1_b") - F.col("n_b") * F.col("e1_a")) + F.col("n_a") * F.col("e2_b") + F.col("n_b") * F.col("e2_a") - 2 * F.col("e1_a") * F.col("e1_b")
    total = both.groupBy(*key).agg(F.sum(smooth).alias("total"))
    # opposite arcs: members of side 2 under the arc across from theirs
    m = _sides(every, axes).withColumn("at", F.when(F.col("side") == 1, F.col("arc")).otherwise(F.pmod(F.col("arc") + half, F.lit(ARCS))))
    below = Window.partitionBy(*key, "axis", "at").orderBy("e").rangeBetween(Window.unboundedPreceding, 0)
    first = F.col("side") == 1
    m = m.withColumns({"n_below": F.count_if(first).over(below), "e_below": F.coalesce(F.sum(F.when(first, F.col("e"))).over(below), F.lit(0.0))})
    excess = m.where("side = 2").groupBy(*key).agg(F.sum(F.col("n_below") * F.col("e") - F.col("e_below")).alias("excess"))
    sums = total.join(excess, key, "left").select(*key, (F.col("total") - 720.0 * F.coalesce("excess", F.lit(0.0))).alias("v"))
    n = members.groupBy("condition", F.col("subgroup").alias("x1")).agg(F.count("*").alias("n"))
    sums = sums.withColumnsRenamed({"s1": "x1", "s2": "x2"}).join(n, ["condition", "x1"])
    # each pair reads three of the sums: they are computed once
    three = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(x).alias("x1"), F.col(y).alias("x2")) for k, x, y in (("b", "s1", "s2"), ("w1", "s1", "s1"), ("w2", "s2", "s2"))])
    read = wanted.select(*key, F.explode(three).alias("x")).select(*key, "x.*").join(sums, ["condition", "x1", "x2"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return read.groupBy(*key).agg(of("w1", "n").alias("n1"), of("w2", "n").alias("n2"), (of("w1", "v") / 2).alias("w1"), (of("w2", "v") / 2).alias("w2"), of("b", "v").alias("b"))


def tw2(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Welch-like T2 of all members from sums of squared distances (radians); 0 for a vanishing denominator."""
    rad2 = (pi / 180) ** 2
    p = torus_sums(pairs, members).withColumns({c: F.col(c) * rad2 for c in ("w1", "w2", "b")})
    n1, n2 = F.col("n1"), F.col("n2")
    between = F.col("b") / (n1 * n2) - F.col("w1") / (n1 * n1) - F.col("w2") / (n2 * n2)
    spread = F.col("w1") / (n1 * n1 * (n1 - 1)) + F.col("w2") / (n2 * n2 * (n2 - 1))
    return p.select("condition", "s1", "s2", "n1", "n2", F.when((n1 > 1) & (n2 > 1) & (spread > 1e-12), between / spread).otherwise(0.0).alias("stat"))


#: The most frequencies of an axis that mmd2 takes, and the points from which it finds their weights.
FREQUENCIES, POINTS = 64, 512


def kernel_weights(sigma: float, error: float) -> np.ndarray:
    """w[p, q] with exp(-(x^2 + y^2)^2 / (2 sigma^2)) = sum of w[p, q] cos(p x) cos(q y), x and y arcs, up to ``error`` / 4.

    A statistic of mean differences is off by 4 times what the weights left out sum up to at most.
    """
    x = np.arange(POINTS) * 2 * pi / POINTS
    arc = np.minimum(x, 2 * pi - x) ** 2
    w = np.real(np.fft.fft2(np.exp(-0.5 * (arc[:, None] + arc) ** 2 / sigma**2)))[: POINTS // 2 + 1, : POINTS // 2 + 1] / POINTS**2
    twice = np.where(np.arange(len(w)) % (POINTS // 2) > 0, 2.0, 1.0)
    w = w * twice[:, None] * twice
    for k in range(1, FREQUENCIES + 1):
        if 4 * (np.abs(w).sum() - np.abs(w[: k + 1, : k + 1]).sum()) <= error:
            return w[: k + 1, : k + 1]
    raise ValueError(f"a kernel of width {sigma} needs more than {FREQUENCIES} frequencies for an error of {error}")


def _wave_sums(batches: Iterator[pa.RecordBatch], k: int, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Of condition, subgroup, x, y (radians) per subgroup and p < k the rows and, for q < k, the sums of the products of
    cos and sin of p x with those of q y. Sums of more than ``most`` subgroups are given out before the end."""
    held: dict[tuple, tuple[int, np.ndarray]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (condition, subgroup), (n, total) in held.items():
            v = total.reshape(2, k, 2, k).transpose(1, 3, 0, 2).reshape(k, 4 * k)
            yield pa.RecordBatch.from_arrays([pa.array([condition] * k, kinds[0]), pa.array([subgroup] * k, kinds[1]), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["condition", "subgroup", "p", "n", "v"])
        held.clear()

    kinds = [pa.string(), pa.string()]
    for batch in batches:
        kinds = [batch["condition"].type, batch["subgroup"].type]
        codes, names = [], []
        for c in ("condition", "subgroup"):
            d = batch[c].dictionary_encode("encode")
            codes.append(d.indices.to_numpy().astype(np.int64))
            names.append(d.dictionary.to_pylist())
        code = codes[0] * max(1, len(names[1])) + codes[1]
        order = np.argsort(code, kind="stable")
        x, y = (np.exp(1j * batch[c].to_numpy()[order]) for c in "xy")
        waves = []
        for z in (x, y):
            powers = np.ones((k, len(z)), dtype=complex)
            for p in range(1, k):
                np.multiply(powers[p - 1], z, out=powers[p])
            waves.append(np.concatenate((powers.real, powers.imag)))
        groups, starts = np.unique(code[order], return_index=True)
        for g, at, end in zip(groups.tolist(), starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True):
            key = (names[0][g // max(1, len(names[1]))], names[1][g % max(1, len(names[1]))])
            n, total = held.get(key, (0, 0.0))
            held[key] = (n + end - at, total + waves[0][:, at:end] @ waves[1][:, at:end].T)
        if len(held) > most:
            yield from given()
    yield from given()


def mmd2(pairs: DataFrame, members: DataFrame, sigma: float = 1.0, error: float = 1e-9) -> DataFrame:
    """Biased squared maximum mean discrepancy of all members with the kernel exp(-(d2)^2 / (2 sigma^2)), d2 the squared
    distance in radians, up to ``error``.

    The kernel is a function of the differences of both angles, so it is a sum of products of cosines, and the statistic
    a weighted sum of squared differences of the two sides' mean waves: linear in the members, and no pair of them is
    formed. A task adds up its members' waves by subgroup, as products of matrices, before the exchange.
    """
    w = kernel_weights(sigma, error)
    k = len(w)
    spark = members.sparkSession
    products = [(a, b, q) for q in range(k) for a in "cs" for b in "cs"]
    kinds = dict(members.dtypes)
    rows = members.where("phi IS NOT NULL AND psi IS NOT NULL").select("condition", "subgroup", F.radians("phi").alias("x"), F.radians("psi").alias("y"))
    sums = rows.mapInArrow(lambda batches: _wave_sums(batches, k), f"condition {kinds['condition']}, subgroup {kinds['subgroup']}, p int, n bigint, v array<double>")
    sums = sums.groupBy("condition", "subgroup", "p").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"{a}{b}{q}") for i, (a, b, q) in enumerate(products)])
    means = sums.select("condition", "subgroup", "p", "n", F.array(*[F.col(f"{a}{b}{q}") / F.col("n") for a, b, q in products]).alias("v"))
    side = lambda j: means.select("condition", F.col("subgroup").alias(f"s{j}"), "p", F.col("n").alias(f"n{j}"), F.col("v").alias(f"v{j}"))
    weights = spark.createDataFrame([(p, [float(w[p, q]) for _, _, q in products]) for p in range(k)], "p int, w array<double>")
    both = pairs.select("condition", "s1", "s2").join(side(1), ["condition", "s1"]).join(side(2), ["condition", "s2", "p"]).join(F.broadcast(weights), "p")
    gap = F.zip_with("v1", "v2", lambda a, b: (a - b) * (a - b))
    part = F.aggregate(F.zip_with("w", gap, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return both.groupBy("condition", "s1", "s2").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.sum(part).alias("stat"))


def _densities(pairs: DataFrame, members: DataFrame, bins: int, sigma: float, gap) -> DataFrame:
    """Per pair the sum over a bins x bins grid of ``gap`` of both sides' densities, one a subgroup, of all its members."""
    grid = kde_grid(members, ["condition", "subgroup"], bins, sigma)
    side = lambda k: grid.select("condition", F.col("subgroup").alias(f"s{k}"), "i", "j", F.col("p").alias(f"p{k}"))
    both = pairs.select("condition", "s1", "s2").join(side(1), ["condition", "s1"]).join(side(2), ["condition", "s2", "i", "j"])
    return both.groupBy("condition", "s1", "s2").agg(F.sum(gap(F.col("p1") - F.col("p2"))).alias("stat"))


def kde_l1(pairs: DataFrame, members: DataFrame, bins: int, sigma: float) -> DataFrame:
    """L1 distance of the two sides' densities."""
    return _densities(pairs, members, bins, sigma, F.abs)


def kde_d2(pairs: DataFrame, members: DataFrame, bins: int, sigma: float) -> DataFrame:
    """Squared L2 distance of the two sides' densities."""
    return _densities(pairs, members, bins, sigma, lambda d: d * d)


#: Directions of the closed geodesics that projection tests take unless others are given.
GEODESICS = ((1, 0), (0, 1), (1, 1), (2, 3))


def _winding(direction: tuple[int, int]) -> tuple[int, int, int, int]:
    """The direction (a, b) in lowest terms, and integers (i, j) with a j - b i = 1."""
    a, b = direction
    if not (a or b) or a != int(a) or b != int(b):
        raise ValueError(f"a direction is two integers, not both 0: {direction}")
    a, b = a // gcd(a, b), b // gcd(a, b)
    x, y, u, v = a, b, (1, 0), (0, 1)  # extended division: x = u . (a, b), y = v . (a, b)
    while y:
        q = x // y
        x, y, u, v = y, x - q * y, v, (u[0] - q * v[0], u[1] - q * v[1])
    return a, b, -u[1] * x, u[0] * x


def geodesic_position(direction: tuple[int, int], phi: Column | str = "phi", psi: Column | str = "psi") -> Column:
    """Where the orthogonal projection onto the closed geodesic through the origin lies along it, in [0, 1).

    Angles are degrees from -180 on; the torus is the unit square. The lines of the geodesic are a unit of b x - a y
    apart; the nearest one is found by rounding, and a shift by (i, j) leads to it from the line through the origin.
    """
    a, b, i, j = _winding(direction)
    x, y = ((F.col(c) if isinstance(c, str) else c) / 360.0 + 0.5 for c in (phi, psi))
    line = F.floor(a * y - b * x + 0.5)
    t = (a * x + b * y - line * (a * i + b * j)) / float(a * a + b * b)
    return t - F.floor(t)


def circle_wasserstein(pairs: DataFrame, members: DataFrame, positions: list[Column], blocks: int = 1024) -> DataFrame:
    """Circular Wasserstein statistic of each of the positions (in [0, 1), numbered g from 0): n m / (n + m) times the
    variance over t of F_y(Q_x(t)) - t.

    F_y(Q_x(t)) is a step function of t over the sorted members x, so both moments are sums over its ranks. Ranks are
    counted in blocks of the circle, before and within the block.
    """
    key = ["condition", "s1", "s2", "g"]
    placed = members.select("condition", "subgroup", F.posexplode(F.array(*positions)).alias("g", "u"))
    m = _sides(pairs, placed).withColumn("block", F.floor(F.col("u") * blocks))
    sizes = m.groupBy(*key, "block").agg(F.count_if(F.col("side") == 1).alias("n_x"), F.count_if(F.col("side") == 2).alias("n_y"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, "block", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("n_x", "n_y")], F.sum("n_x").over(whole).alias("n"), F.sum("n_y").over(whole).alias("m"))
    here = Window.partitionBy(*key, "block")
    m = m.withColumn("below", F.count_if(F.col("side") == 2).over(here.orderBy("u").rangeBetween(Window.unboundedPreceding, 0)))
    x = m.where("side = 1").withColumn("k", F.row_number().over(here.orderBy("u"))).join(sizes, [*key, "block"])
    f, n, k = (F.col("n_y_before") + F.col("below")) / F.col("m"), F.col("n"), F.col("n_x_before") + F.col("k")
    lo, hi = (k - 1) / n, k / n
    first = f / n - (hi * hi - lo * lo) / 2
    second = f * f / n - f * (hi * hi - lo * lo) + (hi * hi * hi - lo * lo * lo) / 3
    s = x.groupBy(*key).agg(F.max("n").alias("n1"), F.max("m").alias("n2"), F.sum(first).alias("a"), F.sum(second).alias("b"))
    return s.select(*key, "n1", "n2", (F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) * (F.col("b") - F.col("a") * F.col("a"))).alias("stat"))


def axis_wasserstein(pairs: DataFrame, members: DataFrame, axis: str, blocks: int = 1024) -> DataFrame:
    """The statistic of one axis."""
    return circle_wasserstein(pairs, members, [F.col(axis) / 360.0 + 0.5], blocks).drop("g")


def share_above(values: DataFrame, null: DataFrame, column: str, blocks: int = 1024) -> DataFrame:
    """Adds pval: the share of the null sample (column value) that is greater than ``column``. Either may have any size.

    Both are cut at quantiles of the null sample. Its distinct values are counted by block; the blocks' counts, at most
    ``blocks`` rows, are summed from above by the driver. Within a block the null's values and those asked are put in
    order together. Without a null sample pval is null.
    """
    cuts = sorted(set(null.agg(F.percentile_approx(F.col("value").cast("double"), [k / blocks for k in range(1, blocks)], 10 * blocks)).first()[0] or []))
    if not cuts:
        return values.withColumn("pval", F.lit(None).cast("double"))
    at = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= c))
    counted = null.where("value IS NOT NULL").groupBy(F.col("value").cast("double").alias("_v")).agg(F.count("*").alias("_k")).withColumn("_block", at(F.col("_v")))
    held = {r._block: r.k for r in counted.groupBy("_block").agg(F.sum("_k").alias("k")).collect()}
    above = [sum(held.get(j, 0) for j in range(i + 1, len(cuts) + 1)) for i in range(len(cuts) + 1)]
    asked = values.withColumn("_v", F.col(column).cast("double")).withColumn("_block", at(F.col("_v")))
    both = asked.withColumns({"_k": F.lit(0).cast("bigint"), "_asked": F.lit(True)}).unionByName(counted.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    here = Window.partitionBy("_block")
    over = F.sum("_k").over(here.orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("_k").over(Window.partitionBy("_block", "_v"))
    before = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in above]), F.col("_block") + 1)
    done = both.withColumn("pval", (before + over) / float(sum(held.values())))
    return done.where("_asked").select(*values.columns, F.when(F.col(column).isNotNull(), F.col("pval")).alias("pval"))


def projection_test(pairs: DataFrame, members: DataFrame, null: DataFrame, geodesics: tuple[tuple[int, int], ...] = GEODESICS) -> DataFrame:
    """Circular Wasserstein tests of the members' projections onto closed geodesics against a null sample (value) of any
    size: stat, the mean of the statistics, and pval = min(1, g times the least of the g shares of the null above)."""
    every = share_above(circle_wasserstein(pairs, members, [geodesic_position(g) for g in geodesics]), null, "stat")
    return every.groupBy("condition", "s1", "s2").agg(F.avg("stat").alias("stat"), F.least(F.lit(1.0), len(geodesics) * F.min("pval")).alias("pval"))


def _distances(x: np.ndarray) -> np.ndarray:
    d = np.abs(x[:, None, :] - x[None, :, :])
    d = np.radians(np.minimum(d, 360 - d))
    return (d * d).sum(axis=2)


#: Of the angles of a resample (n x 2), the function from labellings (p x n, true: side 1) to their p statistics.
Statistic = Callable[[np.ndarray], np.ndarray]


def _tw(x: np.ndarray) -> Statistic:
    d2 = _distances(x)

    def statistic(one: np.ndarray) -> np.ndarray:
        one = one.astype(float)
        n, m = one.sum(axis=1), (1 - one).sum(axis=1)
        to_one = one @ d2
        w1, c = (to_one * one).sum(axis=1) / 2, (to_one * (1 - one)).sum(axis=1)
        w2 = d2.sum() / 2 - w1 - c
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = w1 / (n * n * (n - 1)) + w2 / (m * m * (m - 1))
            between = c / (n * m) - w1 / n**2 - w2 / m**2
            return np.where((n > 1) & (m > 1) & (spread > 1e-12), between / spread, 0.0)

    return statistic


def _signs(one: np.ndarray) -> np.ndarray:
    """1 / n on side 1 and -1 / m on side 2."""
    n, m = one.sum(axis=1, keepdims=True), (~one).sum(axis=1, keepdims=True)
    return np.where(one, 1 / np.maximum(n, 1), -1 / np.maximum(m, 1))


def _mmd(x: np.ndarray) -> Statistic:
    k = np.exp(-0.5 * _distances(x) ** 2)

    def statistic(one: np.ndarray) -> np.ndarray:
        sign = _signs(one)
        return ((sign @ k) * sign).sum(axis=1)

    return statistic


def _kde_g(bins: int, sigma: float) -> Callable[[np.ndarray], Statistic]:
    centres = -180.0 + 360.0 / bins * np.arange(bins)

    def of(x: np.ndarray) -> Statistic:
        gap = np.abs(x[:, :, None] - centres)
        w = np.exp(-0.5 * (np.minimum(gap, 360 - gap) / sigma) ** 2)
        w /= w.sum(axis=2, keepdims=True)
        return lambda one: np.array([np.abs((w[:, 0] * s[:, None]).T @ w[:, 1]).sum() for s in _signs(one)])

    return of


def _torus_p(geodesics: tuple[tuple[int, int], ...]) -> Callable[[np.ndarray], Statistic]:
    """Mean circular Wasserstein statistic of the projections. The pooled sample is sorted once for each direction; every
    labelling's statistic follows from counts up to each place of that order."""

    def position(direction: tuple[int, int], x: np.ndarray) -> np.ndarray:
        a, b, i, j = _winding(direction)
        u, v = x.T / 360.0 + 0.5
        t = (a * u + b * v - np.floor(a * v - b * u + 0.5) * (a * i + b * j)) / (a * a + b * b)
        return t - np.floor(t)

    def of(x: np.ndarray) -> Statistic:
        orders = []
        for g in geodesics:
            u = position(g, x)
            order = np.argsort(u, kind="stable")
            orders.append((order, np.searchsorted(u[order], u[order], "right") - 1))

        def statistic(one: np.ndarray) -> np.ndarray:
            n, m = one.sum(axis=1, keepdims=True), (~one).sum(axis=1, keepdims=True)
            total = np.zeros(len(one))
            for order, last in orders:
                first = one[:, order]
                f = np.cumsum(~first, axis=1)[:, last] / np.maximum(m, 1)  # of side 2, up to equal values
                k = np.cumsum(first, axis=1)
                lo, hi = (k - 1) / np.maximum(n, 1), k / np.maximum(n, 1)
                a = (first * (f / np.maximum(n, 1) - (hi**2 - lo**2) / 2)).sum(axis=1)
                b = (first * (f**2 / np.maximum(n, 1) - f * (hi**2 - lo**2) + (hi**3 - lo**3) / 3)).sum(axis=1)
                total += (n * m / (n + m))[:, 0] * (b - a * a)
            return total / len(orders)

        return statistic

    return of


STATISTICS: dict[str, Callable[[np.ndarray], Statistic]] = {"tw": _tw, "mmd": _mmd, "kde_g": _kde_g(128, 2.0), "torus_p": _torus_p(GEODESICS)}
#: Labellings whose statistics are found at once, and the relative difference below which two statistics tie.
TOGETHER, TIE = 64, 1e-9


def labellings(seed: int, b: int, first: int, last: int, n: int, m: int) -> np.ndarray:
    """Permutations ``first`` .. ``last`` of the labels of resample b: the n members with the least numbers are side 1."""
    i, k = np.arange(first, last + 1)[:, None], np.arange(n + m)
    order = np.argsort(hashes.turned(seed + b * 7919 + i * 104_729 + k * 15_485_863), axis=1, kind="stable")
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order[:, :n], True, axis=1)
    return out


def draws(pairs: DataFrame, members: DataFrame, bootstraps: int, n_max: int, key: list[str], seed: int) -> DataFrame:
    """condition, s1, s2, b, side, k, phi, psi: for each pair and resample b the k-th member drawn for each side, with
    replacement, from all members of the subgroup; as many a side as the lesser of the sizes and n_max.

    A draw is a number of seed, pair, b, side and k; members are numbered in the order of a number of ``key`` (integers or
    strings). Both can be repeated by any engine.
    """
    ranked = hash_rank(members, ["condition", "subgroup"], key, seed).select("condition", "subgroup", "rank", "phi", "psi")
    size = members.groupBy("condition", "subgroup").agg(F.count("*").alias("n"))
    p = pairs.select("condition", "s1", "s2")
    for k in "12":
        p = p.join(size.select("condition", F.col("subgroup").alias(f"s{k}"), F.col("n").alias(f"n{k}")), ["condition", f"s{k}"])
    upto = lambda n: F.sequence(F.lit(1), n)
    p = p.withColumn("b", F.explode(upto(F.lit(bootstraps)))).withColumn("k", F.explode(upto(F.least("n1", "n2", F.lit(n_max)).cast("int"))))
    p = p.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"s{k}").alias("subgroup"), F.col(f"n{k}").alias("n")) for k in (1, 2)])).alias("x"))
    at = hashes.number(seed, "condition", "s1", "s2", "b", "x.side", "k") % F.col("x.n") + 1
    p = p.select("condition", "s1", "s2", "b", "k", "x.side", "x.subgroup", at.alias("rank"))
    return p.join(ranked, ["condition", "subgroup", "rank"]).drop("subgroup", "rank")


def bootstrap_permutation(pairs: DataFrame, members: DataFrame, key: list[str], statistic: str = "tw", bootstraps: int = 1, permutations: int = 200, k_min: int = 100, k_th: int = 50, n_max: int = 200, seed: int = 0) -> DataFrame:
    """Mean statistic and pooled permutation p of each pair.

    Each resample draws from all members of both sides (``draws``); labels are permuted (``labellings``); a resample
    stops once k_min permutations are done and its p is at least k_th / (permutations done + 1). The counts of all
    resamples are pooled, p = (exceeding + 1) / (done + 1), and no further resample is taken once the pooled count and p
    meet the same rule. The seed of a pair comes from its names. A group of the Python function holds
    2 * bootstraps * n_max rows at most.
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["b", "side", "k"])
        c, a, b = pdf[["condition", "s1", "s2"]].iloc[0]
        start = hashes.number_of(seed, c, a, b) % hashes.PRIME
        stats, hits, done = [], 0, 0
        for number, one in pdf.groupby("b", sort=True):
            label = one["side"].to_numpy() == 1
            of = STATISTICS[statistic](one[["phi", "psi"]].to_numpy(float))
            seen = of(label[None])[0]
            stats.append(seen)
            own = i = 0
            while i < permutations:
                upto = min(permutations, i + TOGETHER)
                own_upto = own + np.cumsum(of(labellings(start, number, i + 1, upto, label.sum(), (~label).sum())) >= seen - TIE * abs(seen))
                at = np.flatnonzero((np.arange(i + 1, upto + 1) >= k_min) & (own_upto + 1 >= k_th))
                last = at[0] if len(at) else len(own_upto) - 1
                own, i = int(own_upto[last]), i + int(last) + 1
                if len(at):
                    break
            hits, done = hits + own, done + i
            if done >= k_min and hits + 1 >= k_th:
                break
        return pd.DataFrame({"condition": [c], "s1": [a], "s2": [b], "ddist": [float(np.mean(stats))], "pval": [(hits + 1) / (done + 1)]})

    names = pairs.schema
    kind = lambda c: names[c].dataType.simpleString()
    schema = f"condition {kind('condition')}, s1 {kind('s1')}, s2 {kind('s2')}, ddist double, pval double"
    return draws(pairs, members, bootstraps, n_max, key, seed).groupBy("condition", "s1", "s2").applyInPandas(test, schema)


def shuffle_labels(df: DataFrame, column: str, by: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """Permutes a label within groups: the order by one seeded number of the key meets the order by another."""
    a = hash_rank(df, by, key, seed, "_r")
    b = hash_rank(df.select(*by, *key, F.col(column).alias("_label")), by, key, seed + 1, "_r").select(*by, "_label", "_r")
    return a.join(b, [*by, "_r"]).withColumn(column, F.col("_label")).drop("_label", "_r").select(*df.columns)
