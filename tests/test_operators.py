import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from angulon.operators import altloc, contacts, kde, matching, multiplicity, ranks, redundancy, segments, tuples, twosample
from angulon.sources import dataset, metadata


def test_bh_against_a_plain_loop(spark):
    rng = random.Random(21)
    groups = {f"g{k}": [round(rng.random() ** power, digits) for _ in range(rng.choice([1, 2, 9, 60]))] for k, (power, digits) in enumerate([(1, 6), (3, 6), (6, 2), (9, 1)] * 4)}
    rows = [(g, float(p)) for g, ps in groups.items() for p in ps] + [("g1", None)]
    df = spark.createDataFrame(rows, "g string, p double")
    for q in (0.07, 0.4):
        got = {}
        for r in multiplicity.bh(df, "p", q, ["g"]).collect():
            got.setdefault(r.g, []).append(r)
        for g, ps in groups.items():
            want = 0.0
            for i, p in enumerate(sorted(ps), 1):
                if len(ps) > 1 and p <= i * q / len(ps):
                    want = i * q / len(ps)
            assert len(got[g]) == len(ps) + (g == "g1") and all(r.threshold == pytest.approx(want) for r in got[g])
            assert sorted(r.significant for r in got[g] if r.p is not None) == sorted(p <= want for p in ps)
    assert [r.significant for r in got["g1"] if r.p is None] == [None]
    for q in (0.0, 1.0):
        with pytest.raises(ValueError):
            multiplicity.bh(df, "p", q, ["g"])


def test_runs_against_groupby(spark):
    rng = random.Random(22)
    chains = {f"c{k}": [rng.randint(0, 2) for _ in range(rng.randint(1, 40))] for k in range(6)}
    df = spark.createDataFrame([(c, i, x) for c, xs in chains.items() for i, x in enumerate(xs)], "struct_id string, pos int, x int")
    got = {}
    for r in segments.runs(df, "x").orderBy("struct_id", "start").collect():
        got.setdefault(r.struct_id, []).append((r.value, r.length))
    want = {c: [(v, len(list(run))) for v, run in itertools.groupby(xs)] for c, xs in chains.items()}
    assert got == want
    zeros = sum(x == 0 for xs in chains.values() for x in xs)
    assert sum(r.length * r.n for r in segments.run_length_hist(df, "x", 0).collect()) == zeros


def test_block_ranks(spark):
    rng = random.Random(23)
    rows = [(rng.choice("ab"), i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    for r in ranks.block_rank(df, ["g"], F.floor(F.col("x") * 7), ["x"]).collect():
        assert r["rank"] == sum(g == r.g and x <= r.x for g, _, x in rows)
    hashed = ranks.hash_rank(df, ["g"], ["i"], 4).collect()
    assert all(sorted(r["rank"] for r in hashed if r.g == g) == list(range(1, sum(x[0] == g for x in rows) + 1)) for g in "ab")


def test_ecdf_skips_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 2.0)], "g string, x double")
    assert sorted((r.x or 0, r.ecdf) for r in segments.ecdf(df, "x", ["g"]).collect() if r.x) == [(1.0, 0.5), (2.0, 1.0)]


def test_radius_pairs_match_brute_force(spark):
    rng = np.random.default_rng(0)
    xyz = rng.uniform(-20, 20, (150, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "atom_id int, x double, y double, z double")
    got = {(r.a, r.b) for r in contacts.radius_pairs(df, 5.0).collect()}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if np.linalg.norm(xyz[i] - xyz[j]) <= 5}


def test_two_samples(spark):
    rng = np.random.default_rng(1)
    rows = [("c", s, k + 1, float(a), float(b)) for s, m in (("x", 0), ("y", 0), ("z", 60)) for k, (a, b) in enumerate(rng.normal(m, 20, (400, 2)))]
    members = spark.createDataFrame(rows, "condition string, subgroup string, rank int, phi double, psi double")
    pairs = spark.createDataFrame([("c", "x", "y", 25), ("c", "x", "z", 25)], "condition string, s1 string, s2 string, cap int")
    for stat in twosample.STATISTICS:
        p = {r.s2: r for r in twosample.bootstrap_permutation(pairs, members, ["rank"], stat, bootstraps=3, permutations=60, k_min=60, n_max=30).collect()}
        assert p["z"].pval < 0.05 < p["y"].pval and p["y"].ddist < p["z"].ddist
    drawn = twosample.draws(pairs, members, 3, 30, ["rank"], 0).collect()
    assert len(drawn) == 2 * 2 * 3 * 30 and {(r.phi, r.psi) for r in drawn} <= {r[3:] for r in rows} and len({r.phi for r in drawn}) > 60
    at = {s: np.array([r[3:] for r in rows if r[1] == s]) for s in "xyz"}
    for r in twosample.tw2(pairs, members).collect():
        both = np.vstack([at["x"], at[r.s2]])
        assert r.stat == pytest.approx(twosample.STATISTICS["tw"](both)((np.arange(800) < 400)[None])[0], rel=1e-6) and (r.n1, r.n2) == (400, 400)
    for r in twosample.mmd2(pairs, members).collect():
        both = np.vstack([at["x"], at[r.s2]])
        assert r.stat == pytest.approx(twosample.STATISTICS["mmd"](both)((np.arange(800) < 400)[None])[0], abs=1e-8) and (r.n1, r.n2) == (400, 400)
    l1 = {r.s2: r.stat for r in twosample.kde_l1(pairs, members, 16, 20.0).collect()}
    w = {r.s2: r.stat for r in twosample.axis_wasserstein(pairs, members, "phi", 5).collect()}
    assert l1["y"] < l1["z"] and w["y"] < w["z"]
    for s2, stat in w.items():
        x, y = np.sort(at["x"][:, 0]), at[s2][:, 0]
        f = np.array([(y <= v).mean() for v in x])
        t = (np.arange(40_000) + 0.5) / 40_000
        gap = f[(t * 400).astype(int)] - t
        assert stat == pytest.approx(200 * gap.var(), abs=1e-3)


def test_pair_sums_by_arcs_against_all_pairs(spark):
    rng = np.random.default_rng(24)
    at = {s: np.vstack([rng.integers(-180, 181, (n, 2)), rng.uniform(-180, 180, (n, 2))]) for s, n in (("a", 30), ("b", 17), ("c", 1))}
    members = spark.createDataFrame([("q", s, float(x), float(y)) for s, rows in at.items() for x, y in rows], "condition string, subgroup string, phi double, psi double")
    pairs = spark.createDataFrame([("q", "a", "b"), ("q", "b", "c"), ("q", "a", "a")], "condition string, s1 string, s2 string")

    def total(x, y):
        d = np.abs(x[:, None] - y[None])
        return (np.minimum(d, 360 - d) ** 2).sum()

    got = {(r.s1, r.s2): r for r in twosample.torus_sums(pairs, members).collect()}
    assert set(got) == {("a", "b"), ("b", "c"), ("a", "a")}
    for (a, b), r in got.items():
        x, y = at[a], at[b]
        assert (r.n1, r.n2) == (len(x), len(y)) and r.b == pytest.approx(total(x, y), rel=1e-9)
        assert r.w1 == pytest.approx(total(x, x) / 2, rel=1e-9) and r.w2 == pytest.approx(total(y, y) / 2, rel=1e-9)


def test_shuffled_labels_are_a_permutation_of_each_group(spark):
    rows = [(g, i, f"{g}{i % 7}") for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, label string")
    got = [tuple(r) for r in twosample.shuffle_labels(df, "label", ["g"], ["i"]).collect()]
    assert sorted(r[:2] for r in got) == sorted(r[:2] for r in rows) and sorted((g, x) for g, _, x in got) == sorted((g, x) for g, _, x in rows)
    assert 10 < sum(a != b for a, b in zip(sorted(got), sorted(rows)))
    assert sorted(got) == sorted(tuple(r) for r in twosample.shuffle_labels(df.repartition(5), "label", ["g"], ["i"]).collect())


def test_density_sums_to_one(spark):
    df = spark.createDataFrame([("g", -175.0, 10.0), ("g", 60.0, None), ("g", 80.0, 170.0)], "g string, phi double, psi double")
    cells = kde.kde_grid(df, ["g"], 16, 30.0).collect()
    assert len(cells) == 256 and sum(r.p for r in cells) == pytest.approx(1)
    assert sum(r.p for r in kde.von_mises_grid(df, ["g"], 8, 2.0, 2.0, 0.5).collect()) == pytest.approx(1)


def test_altlocs(spark):
    rows = [("s", 0, "CA", "A", [0.0, 0.0, 0.0], 20.0, 1), ("s", 0, "CA", "B", [3.0, 4.0, 0.0], 20.0, 2), ("s", 0, "C", None, [1.0, 0.0, 0.0], 10.0, 3), ("s", 1, "N", "K", [1.0, 1.3, 0.0], 10.0, 4), ("s", 1, "N", "J", [1.0, 1.4, 0.0], 10.0, 5)]
    atoms = spark.createDataFrame(rows, "struct_id string, pos int, atom string, altloc string, xyz array<double>, b double, serial int")
    assert [(r.pair, r.dist) for r in altloc.ca_distances(atoms).collect()] == [("AB", 5.0)]
    assert sorted((r.pair, round(r.length, 6)) for r in altloc.peptide_bonds(atoms).collect()) == [("~J", 1.4), ("~K", 1.3)]
    assert sorted(r.altloc for r in altloc.relabel(atoms).where("pos = 1").orderBy("serial").collect()) == ["A", "B"]
    assert altloc.backbone_map(atoms).where("pos = 0").first().backbone["CA_B"] == [3.0, 4.0, 0.0]
    rows = [("s", i, a, None, [float(3 * i + k), float((3 * i + k) % 2), float((3 * i + k) % 3)], 1.0, 3 * i + k) for i in range(3) for k, a in enumerate(("N", "CA", "C"))]
    t = altloc.torsions(spark.createDataFrame(rows, atoms.schema)).orderBy("pos").collect()
    assert t[0].phi is None and t[2].psi is None and None not in (t[1].phi, t[1].psi, t[1].omega)
    assert altloc.residue_bfactor(spark.createDataFrame(rows, atoms.schema)).first().bfactor == 1.0


def test_blocks_and_votes(spark):
    blocks = spark.createDataFrame([("p", 0, 3, 1, 4)], "pair_id string, src_start int, src_end int, tgt_start int, tgt_end int")
    s, t = spark.createDataFrame([("p", "ACDE")], "pair_id string, seq string"), spark.createDataFrame([("p", "XACE")], "pair_id string, seq string")
    assert sorted((r.src_idx, r.tgt_idx) for r in matching.expand_blocks(blocks, s, t).collect()) == [(0, 1), (1, 2)]
    v = spark.createDataFrame([("u", "AAA", 3, 2), ("u", "CCC", 3, 1), ("u", "---", 9, 0), ("w", "---", 1, 0)], "unp string, codon string, n int, rank int")
    got = {r.unp: (r.codon, r.codon_score, r.codon_opts) for r in matching.codon_vote(v, ["unp"]).collect()}
    assert got == {"u": ("CCC", 0.2, "AAA/CCC"), "w": ("---", None, "")}


def test_nonredundant_is_independent_and_maximal(spark):
    rng = random.Random(3)
    edges = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.08}
    nodes = spark.range(60)
    got = {r.id for r in redundancy.select_nonredundant(nodes, spark.createDataFrame([(a, b, 0.9) for a, b in edges], "a long, b long, similarity double")).collect()}
    near = lambda v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v}
    assert all(not (near(v) & got) for v in got) and all(near(v) & got for v in range(60) if v not in got)


def test_lcs():
    def plain(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACDE") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert redundancy.lcs_length(a, b) == plain(a, b)


def test_cross_references(spark):
    refs = spark.createDataFrame([("P1", "1ABC", "X-ray", "2.00 A", "L/H=10-22, L=40-90, M=7-8"), ("P1", "2XYZ", "NMR", "-", "A=1-9")], "unp_id string, pdb_id string, method string, resolution string, chains string").selectExpr("*", "'PDB' AS db")
    assert {(r.chain, r.length) for r in metadata.pdb_xrefs(refs).collect()} == {("L", 62), ("H", 12), ("M", 1)}
    ena = spark.createDataFrame([("P1", "EMBL", ["X123", "-"], "mRNA"), ("P1", "EMBL", ["Y999"], "Genomic_DNA")], "unp_id string, db string, ids array<string>, molecule string")
    assert [r.ena_id for r in metadata.ena_xrefs(ena).collect()] == ["X123"]


def test_nested_records(spark):
    region = "array<struct<unp_id:string,beg:int,len:int>>"
    kind = f"entry_id string, title string, refine array<struct<resolution:double,r_free:double>>, em_resolution double, date string, entities array<struct<entity_id:string,src_gen:string,src_nat:string,host:string,chains:array<struct<chain_id:string,auth_id:string,regions:{region}>>>>"
    raw = spark.createDataFrame([("1ABC", "t", None, 3.2, "2020-01-02T00:00", [("1", None, "human", None, [("A", "X", [("P1", 1, 10), ("P1", 20, 5)]), ("B", "B", [("P1", 1, 3), ("P2", 4, 4)])])])], kind)
    flat = {r.chain_id: r for r in metadata.flatten_structures(raw).collect()}
    assert flat["A"].resolution == 3.2 and flat["A"].src_org == "human" and flat["B"].unp_ids == ["P1", "P2"]
    got = {(r.chain_id, r.unp_id): [tuple(x) for x in r.regions] for r in metadata.chain_uniprot_map(raw).collect()}
    assert got[("X", "P1")] == got[("A", "P1")] == [(1, 10), (20, 24)] and got[("B", "P2")] == [(4, 7)]


def test_files(spark, tmp_path):
    (tmp_path / "data-precs").mkdir()
    head = "unp_id,pdb_idx,unp_idx,res_name,res_icode,res_hflag,rel_loc,codon,codon_score,codon_opts,secondary,phi,psi,omega,bfactor\n"
    (tmp_path / "data-precs" / "1ABC_A-x.csv").write_text(head + "P1,1,1,A,,,0.5,GCT,1.0,,H,1.5,NaN,180,3\nP1,2,2,K,,,1.0,AAA,1.0,,H,1,2,180,\n")
    (tmp_path / "meta-structs_all.csv").write_text("pdb_id,resolution\n1ABC:A,1.5\n")
    (tmp_path / "meta.json").write_text('{\n"n": 1\n}')
    res, structs, meta = dataset.read_dataset(spark, str(tmp_path))
    rows = res.orderBy("pos").collect()
    assert [(r.struct_id, r.pos, r.psi) for r in rows] == [("1ABC:A", 0, None), ("1ABC:A", 1, 2.0)] and structs.count() == 1 and meta.first().n == 1
    dataset.write_table(res.select("res_name", "phi"), str(tmp_path / "out"), 2)
    assert sorted(r.phi for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()) == ["1.00", "1.50"]
    calls = []
    for _ in range(2):
        dataset.materialize(spark, str(tmp_path), "m", {"a": 1, "b": 2}, lambda: calls.append(1) or spark.range(3), ignore=("b",))
    assert len(calls) == 1
    (tmp_path / "f.fa").write_text(">ENA|X1|X1.1 some a>b gene\nACGT\nAC\n>Y2 other\nTT\n")
    assert [(r.id, r.description, r.sequence) for r in dataset.read_fasta(spark, str(tmp_path / "f.fa")).orderBy("id").collect()] == [("X1", "some a>b gene", "ACGTAC"), ("Y2", "other", "TT")]
    u = dataset.union_normalized(spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "a int, c int"))
    assert set(u.columns) == {"a", "b", "c"} and u.count() == 2


def test_likelihoods_and_histogram(spark):
    df = spark.createDataFrame([("H", "x"), ("H", "x"), ("E", "y")], "secondary string, codon string")
    got = {(r.condition, r.value): r.p for r in tuples.likelihoods(df, spark.createDataFrame([("x",), ("y",), ("z",)], "codon string")).collect()}
    assert got[("H", "x")] == 1 and got[("E", "z")] == 0 and got[("ANY", "x")] == pytest.approx(2 / 3)
    h = tuples.bootstrap_histogram(spark.range(2000).select((F.col("id") % 4).cast("string").alias("v"), "id"), "v", ["id"], 20).collect()
    assert all(abs(r.p - 0.25) < 0.03 and 0 < r.std < 0.03 for r in h)
