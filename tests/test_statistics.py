"""Statistics of the torus, draws and the normal distribution function against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from angulon.functions import hashes, ratios
from angulon.operators import twosample


def members_of(seed, sizes):
    rng = random.Random(seed)
    return [("c", name, round(rng.uniform(-180, 179.99), 2), round(rng.gauss(0, 60) % 360 - 180, 2)) for name, n in sizes.items() for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "condition string, subgroup string, phi double, psi double")


def pairs_of(spark, names):
    return spark.createDataFrame([("c", a, b) for a, b in itertools.combinations_with_replacement(names, 2)], "condition string, s1 string, s2 string")


def arc(a, b):
    d = abs(a - b)
    return min(d, 360 - d)


def test_numbers_are_those_of_plain_python(spark):
    rows = spark.range(200).select("id", hashes.number(7, "id", F.lit("a|b")).alias("n"), hashes.turned(F.col("id") * 12_345_678).alias("t")).collect()
    assert all(r.n == hashes.number_of(7, r.id, "a|b") < hashes.SPAN and r.t == hashes.turned(r.id * 12_345_678) < hashes.PRIME for r in rows)
    turned = hashes.turned(np.arange(200_000)) / hashes.PRIME
    assert abs(turned.mean() - 0.5) < 0.005 and np.abs(np.histogram(turned, 20, (0, 1))[0] - 10_000).max() < 900


def test_normal_distribution_function(spark):
    z = [-37.0, -12.5, -6.0, -3.0000001, -3.0, -2.9999999, -1.0, -1e-9, 0.0, 0.3, 1.96, 2.9999, 3.0, 5.0, 9.0, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(ratios.norm_cdf(F.col("z")).alias("p")).collect()]
    for x, p in zip(z, got, strict=True):
        want = 0.5 * math.erfc(-x / math.sqrt(2))
        assert abs(p - want) <= 1e-13 * want + 1e-300 or abs(p - want) < 3e-16, x


@pytest.mark.parametrize("sigma", [1.0, 0.5])
def test_mean_discrepancy_of_all_pairs(spark, sigma):
    rows = members_of(1, {"A": 40, "B": 25, "C": 1})
    got = {(r.s1, r.s2): r for r in twosample.mmd2(pairs_of(spark, "ABC"), frame(spark, rows), sigma, 1e-8).collect()}
    of = {s: [r[2:] for r in rows if r[1] == s] for s in "ABC"}
    kernel = lambda x, y: math.exp(-0.5 * ((math.radians(arc(x[0], y[0])) ** 2 + math.radians(arc(x[1], y[1])) ** 2) / sigma) ** 2)
    mean = lambda a, b: sum(kernel(x, y) for x in of[a] for y in of[b]) / len(of[a]) / len(of[b])
    for (a, b), r in got.items():
        assert abs(r.stat - (mean(a, a) + mean(b, b) - 2 * mean(a, b))) <= 1e-8 and (r.n1, r.n2) == (len(of[a]), len(of[b]))
    with pytest.raises(ValueError, match="frequencies"):
        twosample.kernel_weights(1e-4, 1e-9)


def plain_position(direction, phi, psi):
    """By the nearest of many points of the geodesic, then exactly by the lines near it."""
    a, b = direction
    g = math.gcd(a, b)
    a, b = a // g, b // g
    x, y = phi / 360 + 0.5, psi / 360 + 0.5
    best = min((((a * (y - j) - b * (x - i)) ** 2, i, j) for i in range(-4, 5) for j in range(-4, 5)), key=lambda v: v[0])
    _, i, j = best
    return ((a * (x - i) + b * (y - j)) / (a * a + b * b)) % 1


@pytest.mark.parametrize("direction", [(1, 0), (0, 1), (1, 1), (2, 3), (-1, 2), (3, -2), (2, 2), (0, -3), (1, 4)])
def test_projections_onto_closed_geodesics(spark, direction):
    rng = random.Random(3)
    rows = [(rng.uniform(-180, 180), rng.uniform(-180, 180)) for _ in range(60)]
    got = spark.createDataFrame(rows, "phi double, psi double").select("phi", "psi", twosample.geodesic_position(direction).alias("t")).collect()
    for r in got:
        gap = abs(r.t - plain_position(direction, r.phi, r.psi))
        assert 0 <= r.t < 1 and min(gap, 1 - gap) < 1e-9


def plain_circle(x, y):
    """n m / (n + m) times the variance of F_y(Q_x(t)) - t, piece by piece."""
    x, n, m = sorted(x), len(x), len(y)
    a = b = 0.0
    for k, v in enumerate(x):
        f, lo, hi = sum(w <= v for w in y) / m, k / n, (k + 1) / n
        a += f * (hi - lo) - (hi**2 - lo**2) / 2
        b += f * f * (hi - lo) - f * (hi**2 - lo**2) + (hi**3 - lo**3) / 3
    return n * m / (n + m) * (b - a * a)


def test_torus_statistic_of_many_labellings_at_once():
    rng = np.random.default_rng(4)
    x = rng.uniform(-180, 180, (31, 2))
    x[5] = x[9]
    of = twosample.STATISTICS["torus_p"](x)
    labels = twosample.labellings(99, 2, 1, 20, 13, 18)
    assert (labels.sum(axis=1) == 13).all() and len({tuple(v) for v in labels}) == 20
    for one, got in zip(labels, of(labels), strict=True):
        want = np.mean([plain_circle([plain_position(g, *v) for v in x[one]], [plain_position(g, *v) for v in x[~one]]) for g in twosample.GEODESICS])
        assert abs(got - want) < 1e-9


@pytest.mark.parametrize("name", ["tw", "mmd", "kde_g"])
def test_statistics_of_many_labellings_at_once(name):
    rng = np.random.default_rng(5)
    x = rng.uniform(-180, 180, (14, 2))
    labels = twosample.labellings(1, 1, 1, 9, 6, 8)
    together = twosample.STATISTICS[name](x)(labels)
    assert np.allclose(together, [twosample.STATISTICS[name](x)(one[None])[0] for one in labels])
    d2 = np.array([[math.radians(arc(a[0], b[0])) ** 2 + math.radians(arc(a[1], b[1])) ** 2 for b in x] for a in x])
    for one, got in zip(labels, together, strict=True):
        if name == "tw":
            w1, w2, c = d2[one][:, one].sum() / 2, d2[~one][:, ~one].sum() / 2, d2[one][:, ~one].sum()
            assert abs(got - (c / 48 - w1 / 36 - w2 / 64) / (w1 / 180 + w2 / 448)) < 1e-9
        if name == "mmd":
            k = np.exp(-0.5 * d2**2)
            assert abs(got - (k[one][:, one].mean() + k[~one][:, ~one].mean() - 2 * k[one][:, ~one].mean())) < 1e-9


def test_shares_above(spark):
    rng = random.Random(6)
    null = [round(rng.expovariate(3), 2) for _ in range(3000)] + [0.25] * 1500
    asked = [0.0, 0.25, 0.2500001, 0.249, 5.0, -1.0, null[7], max(null), min(null)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*asked, None])], "i int, stat double")
    got = {r.i: r.pval for r in twosample.share_above(df, spark.createDataFrame([(v,) for v in null] + [(None,)], "value double"), "stat", 16).collect()}
    for i, v in enumerate(asked):
        assert abs(got[i] - sum(w > v for w in null) / len(null)) < 1e-12
    assert got[len(asked)] is None
    assert twosample.share_above(df, spark.createDataFrame([], "value double"), "stat").where("pval IS NULL").count() == 10


def test_projection_test_is_the_least_share_times_the_directions(spark):
    rows = members_of(7, {"A": 30, "B": 22})
    null = [0.02 * k for k in range(60)]
    got = twosample.projection_test(pairs_of(spark, "AB"), frame(spark, rows), spark.createDataFrame([(v,) for v in null], "value double")).collect()
    at = lambda s, g: [plain_position(g, *r[2:]) for r in rows if r[1] == s]
    for r in got:
        stats = [plain_circle(at(r.s1, g), at(r.s2, g)) for g in twosample.GEODESICS]
        assert abs(r.stat - np.mean(stats)) < 1e-9
        assert abs(r.pval - min(1, 4 * min(sum(v > s for v in null) / 60 for s in stats))) < 1e-9


def test_permutations_tell_samples_apart(spark):
    rng = random.Random(8)
    rows = [("c", s, rng.gauss(m, 25), rng.gauss(0, 25)) for s, m in (("A", 0), ("B", 0), ("C", 60)) for _ in range(600)]
    df = frame(spark, rows).withColumn("k", F.monotonically_increasing_id())
    for name in ("tw", "mmd", "torus_p"):
        p = {(r.s1, r.s2): r.pval for r in twosample.bootstrap_permutation(pairs_of(spark, "ABC").where("s1 < s2"), df, ["k"], name, permutations=99, k_min=99, n_max=40).collect()}
        assert p["A", "B"] > 0.1 > 0.02 >= p["A", "C"]


@pytest.mark.parametrize("most", [1, 100])
def test_waves_of_batches_add_up(most):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else f"c{i % 2}", f"s{i % 3}", *rng.uniform(-3, 3, 2)) for i in range(90)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 40], strict=True)], ["condition", "subgroup", "x", "y"]) for k in (0, 40, 80)]
    got = {}
    for b in twosample._wave_sums(iter(batches), 4, most):
        for r in b.to_pylist():
            n, v = got.get((r["condition"], r["subgroup"], r["p"]), (0, 0.0))
            got[r["condition"], r["subgroup"], r["p"]] = (n + r["n"], v + np.array(r["v"]))
    for (c, s, p), (n, v) in got.items():
        own = [(x, y) for a, b, x, y in rows if (a, b) == (c, s)]
        want = [sum(f(p * x) * g(q * y) for x, y in own) for q in range(4) for f in (np.cos, np.sin) for g in (np.cos, np.sin)]
        assert n == len(own) and np.allclose(v, want, atol=1e-9)
    assert sum(n for (_, _, p), (n, _) in got.items() if p == 2) == 90
