"""Registered queries that write tables, read them back, or make an order part of their result; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import multiplicity, ranks, segments
from ..sources import dataset, metadata
from . import fixtures as fx
from . import jobs
from .registry import good, query, r
from .registry_stats import ensure_checkpoints


@query("wide_round_trip", f"""WITH {fx.RESIDUES}, g AS (SELECT unp_id, unp_idx, secondary AS condition, codon, count(*) AS n, sum(phi) AS phi, min(psi) AS psi FROM good GROUP BY ALL)
SELECT CAST(a.unp_id AS VARCHAR) AS unp_id, a.condition, a.codon AS codon1, b.codon AS codon2, a.n::INT AS n1, b.n::INT AS n2, round(a.phi,2)+0.0 AS phi1, b.psi+0.0 AS psi2, a.unp_idx::INT AS idx FROM g a JOIN g b ON a.unp_id=b.unp_id AND a.unp_idx=b.unp_idx AND a.condition=b.condition AND a.codon<=b.codon""")
def wide_round_trip(spark, d):
    """Match pairs written as a wide CSV table with lists, and read back by the roles of some of its columns."""
    at = fx.new_folder(spark, "wide")
    m = jobs.match_pairs(good(spark, d)).withColumn("unp_idxs", F.transform("phis1", lambda x: F.col("unp_idx")))
    dataset.write_table(m.drop("unp_idx"), at)
    back = dataset.read_wide(spark, at, ["unp_id", "condition", "codon1", "codon2", "phis1", "psis2", "unp_idxs"])
    total = F.round(F.aggregate("phis1", F.lit(0.0), lambda s, x: s + x), 2) + 0.0
    return back.select("unp_id", "condition", "codon1", "codon2", F.size("phis1").alias("n1"), F.size("psis2").alias("n2"), total.alias("phi1"), (F.array_min("psis2") + 0.0).alias("psi2"), F.col("unp_idxs")[0].alias("idx"))


@query("fasta_round_trip", f"""WITH {fx.CHAIN} SELECT struct_id AS id, 'chain of ' || struct_id AS description, string_agg(res_name, '' ORDER BY pos) AS sequence FROM chain GROUP BY struct_id""")
def fasta_round_trip(spark, d):
    """Every chain written as a FASTA record with lines of 60 letters, and read back."""
    at = fx.new_folder(spark, "fasta")
    c = fx.chain(spark, d).groupBy("struct_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "res_name"))), lambda x: x["res_name"]), "").alias("s"))
    lines = F.regexp_replace("s", r"(.{60})(?=.)", "$1\n")
    c.select(F.concat(F.lit(">ENA|"), "struct_id", F.lit("|"), "struct_id", F.lit(".1 chain of "), "struct_id", F.lit("\n"), lines)).write.text(at)
    return dataset.read_fasta(spark, at)


@query("union_materialized", f"""WITH {fx.RESIDUES} SELECT struct_id, unp_id, unp_idx, secondary, phi, CASE WHEN secondary IN ('H','E') THEN psi END AS psi, CASE WHEN secondary NOT IN ('H','E') THEN bfactor END AS bfactor FROM residues""")
def union_materialized(spark, d):
    """Two tables of which each lacks a column, joined, stored under a digest of the arguments, and read from there."""
    at = fx.new_folder(spark, "materialized")
    df = fx.residues(spark, d)
    key = ["struct_id", "unp_id", "unp_idx", "secondary", "phi"]
    one = df.where("secondary IN ('H','E')").select(*key, "psi")
    two = df.where("secondary NOT IN ('H','E')").select(*key, "bfactor")
    made = lambda: dataset.union_normalized(one, two)
    dataset.materialize(spark, at, "union", {"classes": "HE", "log": 1}, made, ("log",))
    return dataset.materialize(spark, at, "union", {"classes": "HE", "log": 2}, made, ("log",)).select(*key, "psi", "bfactor")


@query("rounded_round_trip", f"WITH {fx.RESIDUES} SELECT struct_id, unp_id, unp_idx, codon, round(phi/7,3)+0.0 AS phi, bfactor FROM residues")
def rounded_round_trip(spark, d):
    """Residues written with three decimals as CSV and read back with their types."""
    at = fx.new_folder(spark, "residues")
    df = fx.residues(spark, d).select("struct_id", "unp_id", "unp_idx", "codon", (F.col("phi") / 7).alias("phi"), F.col("bfactor").cast("double").alias("bfactor"))
    dataset.write_table(df, at)
    kinds = {"struct_id": "bigint", "unp_id": "bigint", "unp_idx": "bigint", "bfactor": "double"}
    return dataset.read_wide(spark, at, types=kinds).select("struct_id", "unp_id", "unp_idx", "codon", r("phi", 3), "bfactor")


@query("reference_order", f"""WITH {fx.STRUCTS}, g AS (SELECT unp_id, count(*) AS group_size, median(resolution) AS group_median, arg_min(struct_id, (resolution, struct_id)) FILTER (seq_len/unp_len BETWEEN 0.9 AND 1.1) AS ref_id FROM structs GROUP BY 1)
SELECT unp_id, ref_id, group_size, round(group_median,6) AS group_median, row_number() OVER (ORDER BY group_size DESC, group_median, unp_id) AS ordinal FROM g WHERE ref_id IS NOT NULL""")
def reference_order(spark, d):
    """The references of all proteins with their place in the report: largest groups first, then the best median."""
    ensure_checkpoints(spark)
    g = metadata.pick_reference(fx.structs(spark, d))
    return ranks.ordinal(g, F.desc("group_size"), "group_median", "unp_id").select("unp_id", "ref_id", "group_size", F.round("group_median", 6).alias("group_median"), "ordinal")


@query("segment_order", f"""WITH {fx.CHAIN}, u AS (SELECT struct_id, pos, pos-row_number() OVER (PARTITION BY struct_id ORDER BY pos) AS g FROM chain WHERE res_icode IS NOT NULL),
s AS (SELECT struct_id, min(pos) AS seg_start, count(*) AS seg_len FROM u GROUP BY struct_id, g)
SELECT struct_id, seg_start, seg_len, row_number() OVER (ORDER BY seg_len DESC, struct_id, seg_start) AS ordinal FROM s""")
def segment_order(spark, d):
    """Unmodelled segments with their place by length, longest first."""
    ensure_checkpoints(spark)
    s = segments.segments(fx.chain(spark, d)).select("struct_id", "seg_start", "seg_len")
    return ranks.ordinal(s, F.desc("seg_len"), "struct_id", "seg_start")


@query("result_sets", f"""WITH {fx.STRUCTS}, a AS (SELECT struct_id, resolution FROM structs WHERE resolution<=2.0), b AS (SELECT struct_id, resolution FROM structs WHERE seq_len>=100)
SELECT 'union' AS how, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'subtraction', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def result_sets(spark, d):
    """Structures of good resolution and long ones: together, in both, and in the first alone."""
    s = fx.structs(spark, d).select("struct_id", "resolution", "seq_len")
    a, b = s.where("resolution <= 2.0").drop("seq_len"), s.where("seq_len >= 100").drop("seq_len")
    one = lambda how: multiplicity.result_set(a, b, ["struct_id"], how).select(F.lit(how).alias("how"), "struct_id", "resolution")
    return one("union").union(one("intersection")).union(one("subtraction"))
