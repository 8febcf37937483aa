"""Operators rebuilt for groups of any size, against plain versions, with bounds small enough that every path runs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from angulon.functions import angles
from angulon.operators import blocks, clusters, contacts, ranks, redundancy, segments
from angulon.plans import jobs
from angulon.sources import dataset


def arc(a, b):
    d = abs(a - b)
    return min(d, 360 - d)


@pytest.mark.parametrize("arcs", [4, 64])
def test_frechet_mean_has_the_least_cost(spark, arcs):
    rng = random.Random(1)
    rows = [("a", round(rng.gauss(170, 40) % 360 - 180, 1)) for _ in range(60)] + [("b", 12.5)] * 30 + [("b", -100.0)] * 10 + [(None, -179.0), (None, 179.0), ("c", 5.0), ("c", None)]
    got = {r.g: r for r in angles.frechet_axis(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "x", arcs).collect()}
    for g in {"a", "b", None, "c"}:
        own = [x for h, x in rows if h == g and x is not None]
        cost = lambda c, own=own: sum(arc(x, c) ** 2 for x in own) / len(own)
        best = min(cost(-180 + k / 20) for k in range(7200))
        assert abs(cost(got[g].x) - got[g].x_std ** 2) < 1e-6 and cost(got[g].x) <= best + 1e-9


def residues(rng, n=40, chains=5):
    out = []
    for c in range(chains):
        for pos in range(n):
            if rng.random() < 0.93:
                out.append((f"s{c}", pos, rng.choice("ACDX" if rng.random() < 0.15 else "ACD"), "U_1" if rng.random() < 0.04 else None, None, rng.choice([None, 0, 1, 2, 5]), rng.choice([1.0, 1.0, 1.0, 0.5])))
    return out


def test_window_sweep_counts_the_windows_of_each_context(spark):
    rows = residues(random.Random(2))
    df = spark.createDataFrame(rows, "struct_id string, pos int, res_name string, res_icode string, res_hflag string, contact_smax int, codon_score double")
    got = {(r.context, r.bound): r.n for r in segments.contact_window_sweep(df, [0, 1, 2, 4], [0.0, 2.0], list("ACD")).collect()}
    at = {(r[0], r[1]): r for r in rows}
    good = lambda s, p: (s, p) in at and at[s, p][2] in "ACD" and at[s, p][3] is None
    want = {}
    for c, b in itertools.product([0, 1, 2, 4], [0.0, 2.0]):
        for s, p in at:
            pair = [at.get((s, p)), at.get((s, p + 1))]
            if all(good(s, q) for q in range(p - c, p + c + 2)) and all(x[6] == 1 for x in pair) and max(x[5] or 0 for x in pair) <= b:
                want[c, b] = want.get((c, b), 0) + 1
    assert {k: v for k, v in got.items() if v} == want and want[0, 2.0] > want[2, 2.0] > 0
    for c in (1, 2):
        assert segments.contact_windows(df, c, 2.0, list("ACD")).count() == got[c, 2.0]


@pytest.mark.parametrize("most", [3, 4096])
def test_pairs_within_a_radius_in_dense_cubes(spark, most):
    rng = random.Random(3)
    atoms = [(i, *(rng.uniform(0, 20) if i % 3 else rng.uniform(7.0, 8.0) for _ in range(3))) for i in range(150)]
    df = spark.createDataFrame(atoms, "atom_id long, x double, y double, z double")
    got = {(r.a, r.b): r.dist for r in contacts.radius_pairs(df, 2.5, most=most).collect()}
    want = {(a[0], b[0]): math.dist(a[1:], b[1:]) for a, b in itertools.combinations(atoms, 2) if math.dist(a[1:], b[1:]) <= 2.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize(("threshold", "block_rows"), [(0.8, 5), (0.6, 2000), (0.95, 3)])
def test_aligned_pairs_lose_none(spark, threshold, block_rows):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ABC") for _ in range(rng.randint(1, 40))) for _ in range(25)]
    seqs += ["".join(c for c in s if rng.random() < 0.93) + rng.choice(["", "Z", "ZY"]) for s in seqs] + ["", None, seqs[0]]
    df = spark.createDataFrame(list(enumerate(seqs)), "struct_id int, seq string")
    got = {(r.a, r.b): r.similarity for r in redundancy.aligned_pairs(df, threshold, list("ABC"), block_rows=block_rows).collect()}
    want = {(i, j): plain_lcs(x, y) / math.sqrt(len(x) * len(y)) for (i, x), (j, y) in itertools.combinations(enumerate(seqs), 2) if x and y}
    want = {k: v for k, v in want.items() if v >= threshold - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 10


def test_selected_structures_are_of_a_maximal_set_of_unlike_proteins(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("ACDEFGH") for _ in range(20)) for _ in range(6)]
    seqs = [(u, base[u % 6] if u < 6 else "".join(c if rng.random() < 0.9 else "K" for c in base[u % 6])) for u in range(18)]
    structs = spark.createDataFrame([(i, i % 20, 1.0 + i % 4, 80 + i) for i in range(60)], "struct_id int, unp_id int, resolution double, seq_len int")
    kept, report = jobs.select_structures(structs, F.col("resolution") < 4, [("length", F.col("seq_len") >= 90)], spark.createDataFrame(seqs, "unp_id int, seq string"), 0.75, list("ACDEFGHK"))
    rows = kept.collect()
    fit = {i: i % 20 for i in range(60) if i % 4 < 3 and i >= 10}
    chosen, seq = {r.unp_id for r in rows}, dict(seqs)
    like = lambda a, b: a in seq and b in seq and plain_lcs(seq[a], seq[b]) / 20 > 0.75
    assert {r.struct_id for r in rows} == {i for i, u in fit.items() if u in chosen} and kept.columns == structs.columns
    assert not any(like(a, b) for a, b in itertools.combinations(chosen, 2))
    assert all(u in chosen or any(like(u, c) for c in chosen) for u in set(fit.values())) and len(chosen) < len(set(fit.values()))
    assert {r.filter: r.n for r in report.collect()} == {"length": sum(i % 4 < 3 for i in range(10)), "rejected": sum(i % 4 < 3 for i in range(10)), "total": 45}


def test_nested_clusters(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, rng.gauss(10 * (i % 6), 0.5), rng.gauss(-5 * (i % 3), 0.5)) for i in range(240)] + [(900, 0, None, 1.0), (901, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, c int, x double, y double").withColumn("tag", F.concat(F.lit("t"), "id"))
    done, places = clusters.nested_kmeans(df, "id", ["x", "y"], "c", 3)
    centre = {(r.cluster, r["sub"]): r.centre for r in places.collect()}
    got = {r.id: r for r in done.collect()}
    assert got.keys() == set(range(240)) and len(centre) == 6
    for i, r in got.items():  # each is with its nearest centre, and each centre is the mean of what is with it
        gaps = {s: math.dist(rows[i][2:], p) for (c, s), p in centre.items() if c == rows[i][1]}
        assert r.cluster == rows[i][1] and abs(r.distance - min(gaps.values())) < 1e-9 and r["sub"] == min(gaps, key=gaps.get)
    for (c, s), p in centre.items():
        own = [rows[i][2:] for i, r in got.items() if (r.cluster, r["sub"]) == (c, s)]
        assert math.dist(p, [sum(v) / len(own) for v in zip(*own, strict=True)]) < 1e-5
    table = clusters.sub_clusters(df, df.select("id", F.col("c").alias("cluster")).where("c IS NOT NULL"), "id", ["x", "y"], 3, ["tag"]).collect()
    for r in table:
        own = {i: g.distance for i, g in got.items() if (g.cluster, g["sub"]) == (r.cluster, r["sub"])}
        assert r.n == len(own) and own[r.medoid] == min(own.values()) and r.frequency == r.n / 120 >= 0.5 / 3 and r.tag == f"t{r.medoid}"


def test_ordinals_follow_a_total_order(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 9), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, a int, b double").repartition(7)
    got = {r.i: r.ordinal for r in ranks.ordinal(df, F.desc("a"), "b", "i").collect()}
    assert got == {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2], r[0])), 1)}
    assert ranks.ordinal(df.where("false"), "a").count() == 0


def test_wide_tables_are_typed_by_their_names(spark, tmp_path):
    rows = [("x", 1.25, [1.5, -2.0], [3, 4], ["A-1", "B;"[:1]]), ("y", None, [], None, None), (None, -3.0, [0.125], [7], ["C"])]
    df = spark.createDataFrame(rows, "name string, norm double, ref_phis array<double>, unp_idxs array<int>, codons array<string>")
    dataset.write_table(df, str(tmp_path / "wide"))
    back = dataset.read_wide(spark, str(tmp_path / "wide"))
    assert [t for _, t in back.dtypes] == ["string", "double", "array<double>", "array<int>", "array<string>"]
    assert sorted(map(str, back.collect())) == sorted(str(r) for r in [back.first().__class__(name="x", norm=1.25, ref_phis=[1.5, -2.0], unp_idxs=[3, 4], codons=["A-1", "B"]), back.first().__class__(name="y", norm=None, ref_phis=None, unp_idxs=None, codons=None), back.first().__class__(name=None, norm=-3.0, ref_phis=[0.125], unp_idxs=[7], codons=["C"])])
    some = dataset.read_wide(spark, str(tmp_path / "wide"), ["norm", "name"], {"norm": "string"})
    assert some.dtypes == [("norm", "string"), ("name", "string")]
    with pytest.raises(ValueError, match="nope"):
        dataset.read_wide(spark, str(tmp_path / "wide"), ["nope"])


def test_equal_sequences_are_aligned_once_and_give_all_their_pairs(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("ABCDE") for _ in range(rng.choice([3, 20, 63, 64, 65, 130]))) for _ in range(9)]
    seqs = [base[i % 9] for i in range(40)] + ["", None]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(seqs)], "struct_id string, seq string")
    got = {(r.a, r.b): r.similarity for r in redundancy.aligned_pairs(df, 0.5, block_rows=4).collect()}
    like = lambda x, y: plain_lcs(x, y) / math.sqrt(len(x) * len(y)) if x and y else None
    want = {tuple(sorted((f"s{i}", f"s{j}"))): like(seqs[i], seqs[j]) for i, j in itertools.combinations(range(40), 2)}
    want = {k: v for k, v in want.items() if v >= 0.5 - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 60
    rows = redundancy.aligned_with(df, F.col("struct_id").isin("s0", "s1", "s40"), shares=3).collect()
    assert len(rows) == 3 * 42
    for r in rows:
        expected = like(seqs[int(r.ref_id[1:])], seqs[int(r.struct_id[1:])])
        assert r.similarity == expected if expected is None else abs(r.similarity - expected) < 1e-12
    held = blocks.copies(df.where("seq <> ''"), "struct_id", "seq", most=2)
    assert held.count() > 9 and {i for r in held.collect() for i in r.ids} == {f"s{i}" for i in range(40)}


@pytest.mark.parametrize(("threshold", "block"), [(0.5, 5_000_000), (0.7, 40), (0.9, 40)])
def test_similar_sets_lose_none(spark, threshold, block):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    docs = [{words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randint(1, 60))} for _ in range(40)]
    docs += [{w for w in d if rng.random() < 0.85} | {rng.choice(words)} for d in docs] + [set(docs[0]), set(docs[1]), set(docs[0])]
    tokens = spark.createDataFrame([(i, w) for i, d in enumerate(docs) for w in [*d, *list(d)[:2]]] + [(900, None)], "doc_id long, tok string")
    got = {(r.a, r.b): (r.shared, r.similarity) for r in redundancy.ngram_similarity(tokens, threshold, block_grams=block).collect()}
    want = {(i, j): (len(x & y), len(x & y) / math.sqrt(len(x) * len(y))) for (i, x), (j, y) in itertools.combinations(enumerate(docs), 2)}
    want = {k: v for k, v in want.items() if v[1] >= threshold - 1e-12}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want) and len(want) > 5


def test_pairs_of_sets_are_checked_without_carrying_all_sets(spark):
    """Few pairs of unlike texts with common words leave the blocks."""
    rng = random.Random(10)
    docs = [[f"c{rng.randint(0, 60)}" for _ in range(50)] + [f"r{i}_{k}" for k in range(20)] for i in range(120)]
    sets = spark.createDataFrame([(i, sorted(set(d))) for i, d in enumerate(docs)], "rep long, grams array<string>")
    import numpy as np

    seen = spark.createDataFrame([(w,) for d in docs for w in d], "w string").groupBy(F.xxhash64("w").bitwiseAND(redundancy.CELLS - 1).alias("c")).count().collect()
    counts = np.zeros(redundancy.CELLS, dtype=np.int64)
    for r in seen:
        counts[r.c] = r["count"]
    assert redundancy.similar_sets(sets, counts, 0.7, "rep").count() < 120


def test_sets_without_common_grams_have_no_pairs(spark):
    tokens = spark.createDataFrame([(i, f"w{i}_{k}") for i in range(5) for k in range(6 + 40 * (i > 2))], "doc_id long, tok string")
    assert redundancy.ngram_similarity(tokens, 0.7).count() == 0
    assert {r.doc_id for r in redundancy.nonredundant_sets(tokens, 0.5).collect()} == set(range(5))
