import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from angulon.functions import angles, codons, ratios
from angulon.operators import redundancy


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def frame(spark, groups):
    """Groups of (phi, psi) as rows g, phi, psi."""
    return spark.createDataFrame([(g, float(a), float(b)) for g, rows in groups.items() for a, b in rows], "g string, phi double, psi double")


def arc(a, b):
    """The angle between two directions, from their unit vectors."""
    x, y = np.radians(a), np.radians(b)
    return np.degrees(np.arctan2(np.abs(np.sin(x - y)), np.cos(x - y)))


def cloud(rng, n, wide):
    """Points about a random centre, as angles in [-180, 180)."""
    return (rng.uniform(-180, 180, 2) + rng.uniform(-wide, wide, (n, 2)) + 180) % 360 - 180


def test_arcs_and_torus_distances_are_those_of_unit_vectors(spark):
    rng = np.random.default_rng(11)
    points = [[float(v) for v in row] for row in rng.integers(-180, 181, (80, 4))]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(points)], "i int, a double, b double, c double, d double")
    got = df.select("i", angles.wraparound_diff("a", "c").alias("arc"), angles.torus_distance("a", "b", "c", "d").alias("d"), angles.torus_distance("a", "b", "c", "d", squared=True).alias("d2")).collect()
    for r in got:
        a, b, c, d = points[r.i]
        assert r.arc == pytest.approx(arc(a, c), abs=1e-9)
        assert r.d == pytest.approx(math.hypot(arc(a, c), arc(b, d)), abs=1e-9) and r.d2 == pytest.approx(r.d**2, abs=1e-6)


def test_circular_means_and_deviations_are_those_of_unit_vectors(spark):
    rng = np.random.default_rng(12)
    groups = {f"g{k}": cloud(rng, int(rng.integers(1, 9)), 50) for k in range(25)}
    df = frame(spark, groups).union(spark.createDataFrame([("g0", None, 3.0)], "g string, phi double, psi double"))
    got = {r.g: r for r in df.groupBy("g").agg(angles.circ_mean("phi").alias("m"), *angles.circ_centroid("phi", "psi"), angles.circ_std("phi").alias("s")).collect()}
    for g, rows in groups.items():
        z = np.exp(1j * np.radians(rows)).mean(axis=0)
        assert arc(got[g].m, np.degrees(np.angle(z[0]))) < 1e-6
        if g != "g0":
            assert arc(got[g].phi, np.degrees(np.angle(z[0]))) < 1e-6 and arc(got[g].psi, np.degrees(np.angle(z[1]))) < 1e-6
            assert got[g].s == pytest.approx(np.degrees(np.sqrt(max(0.0, -2 * np.log(abs(z[0]))))), abs=1e-6)


def test_frechet_centroids_minimise_the_squared_arcs(spark):
    rng = np.random.default_rng(13)
    groups = {f"g{k}": np.round(cloud(rng, int(rng.integers(1, 8)), wide)) for k, wide in enumerate([20, 60, 120, 179] * 5)}
    grid = np.arange(-180, 180, 0.05)
    got = {r.g: r for r in angles.frechet_centroid(frame(spark, groups), ["g"]).collect()}
    for g, rows in groups.items():
        for k, name in enumerate(("phi", "psi")):
            cost = (arc(grid[:, None], rows[None, :, k]) ** 2).mean(axis=1)
            own = (arc(got[g][name], rows[:, k]) ** 2).mean()
            assert own <= cost.min() + 1e-6 and own >= cost.min() - 0.2
            assert got[g][f"{name}_std"] == pytest.approx(math.sqrt(own), abs=1e-6)


def test_dihedral_and_wrap(spark):
    p = [F.array(*[F.lit(float(v)) for v in x]) for x in ((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))]
    got = one(spark, angles.dihedral(*p), angles.wrap(F.lit(4.0)), angles.wrap(F.lit(-2.0)), angles.location_sigma(F.lit(8 * math.pi**2)), angles.location_sigma(F.lit(-1.0)))
    assert abs(got[0]) == pytest.approx(math.pi / 2) and got[1] == pytest.approx(4 - 2 * math.pi) and got[2] == -2.0
    assert got[3] == pytest.approx(1) and got[4] is None


def test_codons(spark):
    t = codons.codon_table()
    assert len(t) == 61 and len(set(t.values())) == 20 and t["ATG"] == "M" and t["TGG"] == "W" and t["GCT"] == "A"
    got = one(spark, codons.codon_to_aac(F.lit("gct")), codons.is_synonymous(F.lit("A-GCT_R-CGT"), F.lit("A-GCC_R-AGA")), codons.is_synonymous(F.lit("A-GCT_R-CGT"), F.lit("R-CGT_A-GCT")), codons.group_codon(F.lit("A-GCT"), "last_nucleotide"), codons.consolidate_ss(F.lit("G")), codons.consolidate_ss(F.lit("-")))
    assert tuple(got) == ("A-GCT", True, False, "A-*T", "OTHER", None)
    assert tuple(one(spark, *codons.split_id(F.lit("1abc:A")))) == ("1ABC", "A", None)
    with pytest.raises(Exception):
        one(spark, *codons.split_id(F.lit("nonsense")))
    row = spark.createDataFrame([("A", "K", 87, 3.214)], "c string, r string, i int, d double")
    text = row.select(codons.format_contact("c", "r", "i", "d").alias("t"))
    assert text.first()[0] == "A:K:87:3.21" and tuple(text.select(*codons.parse_contact("t")).first()) == ("A", "K", 87, None, None, 3.21)


def test_intervals(spark):
    lo, hi = ratios.proportion_interval(F.lit(8), F.lit(10), 1.96)
    got = one(spark, lo, hi, ratios.none_seen_bound(F.lit(100), 0.05), ratios.norm_cdf(F.lit(1.96)), *ratios.ratio(F.lit(6.0), F.lit(0.6), F.lit(3.0), F.lit(float("nan"))))
    assert got[0] == pytest.approx(0.4902, abs=1e-3) and got[1] == pytest.approx(0.9433, abs=1e-3)
    assert got[2] == pytest.approx(0.029957, abs=1e-5) and got[3] == pytest.approx(0.975, abs=1e-3) and got[4] == 2 and got[5] == pytest.approx(0.2)


def test_means_across_180_do_not_depend_on_the_order(spark):
    halves = [-135.0, -133.0, -114.0, -112.0, -22.0, -1.0]
    both = halves + [-x for x in halves]
    orders = [sorted(both), sorted(both, key=abs), halves[::-1] + [-x for x in halves], sorted(both)[::-1], [170.0, -180.0, -170.0], [-180.0, 170.0, -170.0], [170.0, -170.0, -180.0]]
    df = frame(spark, {f"g{i}": [(x, x) for x in order] for i, order in enumerate(orders)}).coalesce(1)
    got = {r.g: r.m for r in df.groupBy("g").agg(angles.circ_mean("phi").alias("m")).collect()}
    assert got == {f"g{i}": 180.0 if i < 4 else -180.0 for i in range(len(orders))}
    rows = df.select(F.lit("HELIX").alias("secondary"), F.lit(1).alias("unp_id"), F.lit(1).alias("unp_idx"), F.col("g").alias("codon"), "phi", "psi")
    assert {r.codon: (r.phi, r.psi) for r in redundancy.aggregate_redundant(rows).collect()} == {g: (m, m) for g, m in got.items()}
    sums = [0.1, -1e-17, float("nan"), None]
    r = spark.createDataFrame([(i, x) for i, x in enumerate(sums)], "i int, x double").agg(angles.exact_sum(F.when(F.col("i") != 2, F.col("x"))), angles.exact_sum(F.col("x"))).first()
    assert abs(r[0] - 0.1) < 1e-15 and math.isnan(r[1])
