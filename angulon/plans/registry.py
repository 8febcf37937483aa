"""The registered queries of the library's own operators, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, codons
from ..operators import contacts, frequency, redundancy, segments, tuples
from ..sources import metadata
from . import fixtures as fx
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LETTERS = ["A", "C", "D", "E"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def r(c: str, digits: int = 6):
    """Rounded, and without a sign on zero."""
    return (F.round(c, digits) + 0.0).alias(c)


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.quality_filter(fx.residues(spark, sf_dir))


# --- redundancy and groups ---------------------------------------------------------------------------------------

CENTROID = fx.RESIDUES + """,
g AS (SELECT secondary AS condition, unp_id, unp_idx, codon, count(*) AS n, avg(sin(radians(phi))) AS sp, avg(cos(radians(phi))) AS cp,
  avg(sin(radians(psi))) AS ss, avg(cos(radians(psi))) AS cs FROM good GROUP BY ALL),
c AS (SELECT *, CASE WHEN sqrt(sp*sp+cp*cp)>1e-9 THEN degrees(atan2(sp,cp)) END AS phi, CASE WHEN sqrt(ss*ss+cs*cs)>1e-9 THEN degrees(atan2(ss,cs)) END AS psi FROM g),
agg AS (SELECT c.condition, c.unp_id, c.unp_idx, c.codon, any_value(c.n) AS group_size, any_value(c.phi) AS phi, any_value(c.psi) AS psi,
  sqrt(avg(pow(least(abs(m.phi-c.phi),360-abs(m.phi-c.phi)),2)+pow(least(abs(m.psi-c.psi),360-abs(m.psi-c.psi)),2))) AS std
  FROM c JOIN good m ON m.secondary=c.condition AND m.unp_id=c.unp_id AND m.unp_idx=c.unp_idx AND m.codon=c.codon GROUP BY 1,2,3,4)"""


@query("residue_group_sizes", f"""WITH {fx.RESIDUES}, d AS (SELECT DISTINCT secondary, aa, codon, unp_id, unp_idx FROM good)
SELECT secondary AS condition, CASE WHEN grouping(aa)=1 AND grouping(codon)=1 THEN 'total' WHEN grouping(codon)=1 THEN 'aa' ELSE 'codon' END AS level,
 coalesce(aa, codon) AS subgroup, count(*) AS n FROM d GROUP BY GROUPING SETS ((secondary),(secondary,aa),(secondary,codon))""")
def residue_group_sizes(spark, d):
    return redundancy.group_sizes(good(spark, d))


@query("redundancy_centroid", f"""WITH {CENTROID}
SELECT condition, unp_id, unp_idx, codon, group_size, round(phi,6)+0.0 AS phi, round(psi,6)+0.0 AS psi, round(std,6)+0.0 AS std FROM agg""")
def redundancy_centroid(spark, d):
    df = redundancy.aggregate_redundant(good(spark, d))
    return df.select("condition", "unp_id", "unp_idx", "codon", "group_size", r("phi"), r("psi"), r("std"))


BEST = fx.RESIDUES + "," + fx.STRUCTS + """,
best AS (SELECT g.secondary AS condition, g.unp_id, g.unp_idx, g.codon, count(*) AS group_size,
  arg_min(g.phi, (s.resolution, g.struct_id, g.phi, g.psi)) AS phi, arg_min(g.psi, (s.resolution, g.struct_id, g.phi, g.psi)) AS psi
  FROM good g JOIN structs s ON g.struct_id=s.struct_id GROUP BY ALL)"""


def best_residues(spark, d):
    return redundancy.aggregate_redundant(metadata.with_resolution(good(spark, d), fx.structs(spark, d)), how="res", spread=False)


@query("redundancy_best_resolution", f"WITH {BEST} SELECT condition, unp_id, unp_idx, codon, group_size, phi, psi FROM best")
def redundancy_best_resolution(spark, d):
    return best_residues(spark, d).select("condition", "unp_id", "unp_idx", "codon", "group_size", "phi", "psi")


@query("redundancy_members", f"""WITH {fx.RESIDUES}, g AS (SELECT *, count(*) OVER (PARTITION BY secondary, unp_id, unp_idx, codon) AS group_size FROM good)
SELECT secondary AS condition, unp_id, unp_idx, codon, group_size, phi, psi FROM g WHERE group_size>=2""")
def redundancy_members(spark, d):
    return redundancy.aggregate_redundant(good(spark, d), how="none", min_size=2).select("condition", "unp_id", "unp_idx", "codon", "group_size", "phi", "psi")


@query("tuples_k2", f"""WITH {BEST}, t AS (SELECT *, lead(unp_idx) OVER w AS i1, lead(condition) OVER w AS c1, lead(codon) OVER w AS k1, lead(phi) OVER w AS p1, lead(group_size) OVER w AS g1
 FROM best WINDOW w AS (PARTITION BY unp_id ORDER BY unp_idx, condition, codon))
SELECT unp_id, unp_idx, condition AS secondary, codon || '_' || k1 AS codon, p1 AS phi, psi, least(group_size, g1) AS group_size FROM t WHERE i1=unp_idx+1 AND c1=condition""")
def tuples_k2(spark, d):
    return tuples.build_tuples(best_residues(spark, d), 2).drop("std")


@query("codon_likelihoods", f"""WITH {fx.RESIDUES}, n AS (SELECT secondary AS condition, codon AS value, count(*) AS n FROM good GROUP BY ALL),
t AS (SELECT condition, sum(n) AS total FROM n GROUP BY 1), u AS (SELECT DISTINCT codon AS value FROM residues),
e AS (SELECT t.condition, u.value, t.total/(SELECT sum(total) FROM t) AS pc, coalesce(n.n,0)/t.total AS p FROM t CROSS JOIN u LEFT JOIN n ON n.condition=t.condition AND n.value=u.value)
SELECT condition, value, round(pc,9) AS p_condition, round(p,9) AS p FROM e UNION ALL SELECT 'ANY', value, 1.0::DOUBLE, round(sum(pc*p),9) FROM e GROUP BY value""")
def codon_likelihoods(spark, d):
    universe = fx.residues(spark, d).select("codon").distinct()
    return tuples.likelihoods(good(spark, d), universe).select("condition", "value", r("p_condition", 9), r("p", 9))


@query("full_group_counts", f"""WITH {fx.RESIDUES} SELECT coalesce(secondary,'ANY') AS secondary, count(*) AS n, count(DISTINCT unp_id) AS n_unp FROM good GROUP BY ROLLUP(secondary)""")
def full_group_counts(spark, d):
    return redundancy.groupby_with_full(good(spark, d), "secondary", [F.count("*").alias("n"), F.countDistinct("unp_id").alias("n_unp")])


@query("dataset_statistics", f"WITH {fx.RESIDUES} SELECT count(DISTINCT struct_id) AS n_structs, count(DISTINCT unp_id) AS n_unp, count(*) AS n_residues, sum(CASE WHEN bfactor IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_no_b FROM residues")
def dataset_statistics(spark, d):
    return jobs.dataset_statistics(fx.residues(spark, d))


# --- angles -------------------------------------------------------------------------------------------------------


@query("torus_distance_stats", f"""WITH {fx.RESIDUES}, l AS (SELECT *, lag(phi) OVER w AS p0, lag(psi) OVER w AS s0 FROM residues WINDOW w AS (PARTITION BY struct_id ORDER BY unp_idx, unp_id, codon, phi, psi)),
x AS (SELECT secondary, least(abs(phi-p0),360-abs(phi-p0)) AS a, least(abs(psi-s0),360-abs(psi-s0)) AS b FROM l WHERE p0 IS NOT NULL)
SELECT secondary, count(*) AS n, round(avg(a),6)+0.0 AS arc, round(avg(sqrt(a*a+b*b)),6)+0.0 AS dist, round(max(a*a+b*b),4)+0.0 AS d2_max FROM x GROUP BY 1""")
def torus_distance_stats(spark, d):
    w = Window.partitionBy("struct_id").orderBy("unp_idx", "unp_id", "codon", "phi", "psi")
    df = fx.residues(spark, d).withColumns({"p0": F.lag("phi").over(w), "s0": F.lag("psi").over(w)}).where("p0 IS NOT NULL")
    df = df.groupBy("secondary").agg(F.count("*").alias("n"), F.avg(angles.wraparound_diff("phi", "p0")).alias("arc"), F.avg(angles.torus_distance("phi", "psi", "p0", "s0")).alias("dist"), F.max(angles.torus_distance("phi", "psi", "p0", "s0", squared=True)).alias("d2_max"))
    return df.select("secondary", "n", r("arc"), r("dist"), r("d2_max", 4))


@query("circular_stats", f"""WITH {fx.RESIDUES}, g AS (SELECT aa, unp_idx, count(*) AS n, avg(sin(radians(phi))) AS s, avg(cos(radians(phi))) AS c FROM residues GROUP BY ALL)
SELECT aa, unp_idx, n, round(degrees(atan2(s,c)),6)+0.0 AS phi, round(degrees(sqrt(-2*ln(sqrt(s*s+c*c)))),6)+0.0 AS phi_std FROM g""")
def circular_stats(spark, d):
    df = fx.residues(spark, d).groupBy("aa", "unp_idx").agg(F.count("*").alias("n"), *angles.circ_centroid("phi", "psi"))
    return df.select("aa", "unp_idx", "n", r("phi"), r("phi_std"))


@query("frechet_stats", f"""WITH {fx.RESIDUES}, m AS (SELECT secondary, codon, unp_idx, psi AS x, row_number() OVER (PARTITION BY secondary, codon, unp_idx ORDER BY psi)-1 AS k FROM good),
g AS (SELECT secondary, codon, unp_idx, count(*) AS n, sum(x) AS s FROM m GROUP BY ALL),
cand AS (SELECT DISTINCT secondary, codon, unp_idx, n, (s+360.0*k)/n AS raw FROM g JOIN m USING (secondary, codon, unp_idx)),
cw AS (SELECT *, raw-360.0*floor((raw+180.0)/360.0) AS c FROM cand),
cost AS (SELECT secondary, codon, unp_idx, round(c,9) AS c, round(avg(pow(least(abs(x-c),360-abs(x-c)),2)),9) AS v FROM cw JOIN m USING (secondary, codon, unp_idx) GROUP BY secondary, codon, unp_idx, c)
SELECT secondary, codon, unp_idx, round(arg_min(c,(v,abs(c),c)),5)+0.0 AS psi, round(sqrt(min(v)),5)+0.0 AS psi_std FROM cost GROUP BY ALL""")
def frechet_stats(spark, d):
    df = angles.frechet_axis(good(spark, d), ["secondary", "codon", "unp_idx"], "psi", "psi")
    return df.select("secondary", "codon", "unp_idx", r("psi", 5), r("psi_std", 5))


@query("location_sigma", f"WITH {fx.RESIDUES} SELECT secondary, count(bfactor) AS n, round(avg(sqrt(bfactor/(8*pi()*pi()))),8) AS sigma FROM residues GROUP BY 1")
def location_sigma(spark, d):
    df = fx.residues(spark, d).groupBy("secondary").agg(F.count("bfactor").alias("n"), F.avg(angles.location_sigma("bfactor")).alias("sigma"))
    return df.select("secondary", "n", r("sigma", 8))


@query("cross_bond", f"""WITH {fx.RESIDUES} SELECT struct_id, unp_id, unp_idx, codon, lead(phi) OVER (PARTITION BY struct_id ORDER BY unp_idx, unp_id, codon, phi, psi) AS phi_next, psi AS psi_here, (phi+psi)/2 AS omega_here FROM residues""")
def cross_bond(spark, d):
    w = Window.partitionBy("struct_id").orderBy("unp_idx", "unp_id", "codon", "phi", "psi")
    df = angles.cross_bond(fx.residues(spark, d).withColumn("omega", (F.col("phi") + F.col("psi")) / 2), w)
    return df.select("struct_id", "unp_id", "unp_idx", "codon", "phi_next", "psi_here", "omega_here")


@query("same_ss_pairs", f"""WITH {fx.RESIDUES}, l AS (SELECT *, lag(secondary) OVER (PARTITION BY struct_id ORDER BY unp_idx, unp_id, codon, phi, psi) AS s0 FROM residues)
SELECT secondary AS pair_ss, count(*) AS n FROM l WHERE s0=secondary GROUP BY 1""")
def same_ss_pairs(spark, d):
    w = Window.partitionBy("struct_id").orderBy("unp_idx", "unp_id", "codon", "phi", "psi")
    df = fx.residues(spark, d).withColumn("pos", F.row_number().over(w))
    return segments.same_ss_pairs(df).where("pair_ss IS NOT NULL").groupBy("pair_ss").agg(F.count("*").alias("n"))


# --- codons -------------------------------------------------------------------------------------------------------


@query("codon_names", f"""WITH {fx.RESIDUES} SELECT codon, split_part(codon,'-',1) AS aa, split_part(codon,'-',2) AS triple, split_part(codon,'-',1) || '-*' AS any_pos,
 split_part(codon,'-',1) || '-*' || right(codon,1) AS last_pos, count(*) AS n FROM residues GROUP BY ALL""")
def codon_names(spark, d):
    df = fx.residues(spark, d).groupBy("codon").agg(F.count("*").alias("n"))
    return df.select("codon", codons.aac_aa("codon").alias("aa"), codons.aac_codon("codon").alias("triple"), codons.group_codon("codon", "any").alias("any_pos"), codons.group_codon("codon", "last_nucleotide").alias("last_pos"), "n")


@query("synonymous_tuples", f"""WITH {BEST}, t AS (SELECT *, lead(unp_idx) OVER w AS i1, lead(condition) OVER w AS c1, lead(codon) OVER w AS k1 FROM best WINDOW w AS (PARTITION BY unp_id ORDER BY unp_idx, condition, codon)),
k AS (SELECT DISTINCT codon || '_' || k1 AS t, split_part(codon,'-',1) || '_' || split_part(k1,'-',1) AS aas FROM t WHERE i1=unp_idx+1 AND c1=condition)
SELECT a.t AS t1, b.t AS t2, a.aas FROM k a JOIN k b ON a.aas=b.aas AND a.t<b.t""")
def synonymous_tuples(spark, d):
    """Among tuples with the same first acid, those that code for the same acids."""
    t = tuples.build_tuples(best_residues(spark, d), 2).select(F.col("codon").alias("t")).distinct()
    t = t.withColumn("first", codons.aac_aa("t"))
    both = t.toDF("t1", "first").join(t.toDF("t2", "first"), "first").where("t1 < t2")
    return both.where(codons.is_synonymous("t1", "t2")).select("t1", "t2", codons.tuple_to_aas("t1").alias("aas"))


# --- chains -------------------------------------------------------------------------------------------------------

SEG = fx.CHAIN + """,
f AS (SELECT *, (res_icode IS NOT NULL) AS u, min(CASE WHEN res_hflag IS NULL THEN pos END) OVER (PARTITION BY struct_id) AS f0, max(CASE WHEN res_hflag IS NULL THEN pos END) OVER (PARTITION BY struct_id) AS l0 FROM chain),
s1 AS (SELECT *, pos - row_number() OVER (PARTITION BY struct_id ORDER BY pos) AS grp FROM f WHERE u),
s2 AS (SELECT struct_id, min(pos) AS seg_start, count(*)::INT AS seg_len, string_agg(res_name, '' ORDER BY pos) AS seg_seq, min(f0) AS f0, max(l0) AS l0 FROM s1 GROUP BY struct_id, grp),
seg AS (SELECT struct_id, (row_number() OVER (PARTITION BY struct_id ORDER BY seg_start)-1)::INT AS seg_idx, seg_start, seg_len, seg_seq,
 CASE WHEN seg_start=f0 THEN 'nterm' WHEN seg_start+seg_len-1=l0 THEN 'cterm' ELSE 'inter' END AS seg_type FROM s2)"""


def segs(spark, d):
    return segments.segments(fx.chain(spark, d))


@query("segments", f"WITH {SEG} SELECT * FROM seg")
def q_segments(spark, d):
    return segs(spark, d)


@query("segment_context", f"""WITH {SEG} SELECT seg.struct_id, seg_idx, max(CASE WHEN pos=seg_start-2 THEN res_name END) AS m2, max(CASE WHEN pos=seg_start-1 THEN res_name END) AS m1,
 max(CASE WHEN pos=seg_start+seg_len THEN res_name END) AS p1, max(CASE WHEN pos=seg_start+seg_len+1 THEN res_name END) AS p2
 FROM seg JOIN chain ON seg.struct_id=chain.struct_id GROUP BY seg.struct_id, seg_idx""")
def segment_context(spark, d):
    return segments.segment_context(fx.chain(spark, d), segs(spark, d), 2, "res_name")


@query("dedup_segments", f"""WITH {SEG} SELECT seg_start, seg_seq, struct_id, seg_idx, seg_len, seg_type FROM (SELECT *, row_number() OVER (PARTITION BY seg_start, seg_seq ORDER BY struct_id, seg_idx) AS k FROM seg) WHERE k=1""")
def dedup_segments(spark, d):
    return redundancy.dedup_keep_first(segs(spark, d), ["seg_start", "seg_seq"], ["struct_id", "seg_idx"]).select("seg_start", "seg_seq", "struct_id", "seg_idx", "seg_len", "seg_type")


@query("segment_filters", f"""WITH {SEG}, l AS (SELECT unnest(CASE WHEN seg_type='inter' AND seg_len>1 THEN ['any','any>1','inter','inter>1'] WHEN seg_len>1 THEN ['any','any>1'] WHEN seg_type='inter' THEN ['any','inter'] ELSE ['any'] END) AS label FROM seg)
SELECT label, count(*) AS n, round(100.0::DOUBLE*(1-count(*)/(SELECT count(*) FROM seg)),6)+0.0 AS dropped_percent FROM l GROUP BY 1""")
def segment_filters(spark, d):
    return segments.labelled_filters(segs(spark, d)).select("label", "n", r("dropped_percent"))


@query("short_structure_segments", f"""WITH {SEG}, st AS (SELECT struct_id, count(*)::INT AS seq_len FROM chain GROUP BY 1)
SELECT seg.struct_id, seg_idx, seg_start, seg_len, seg_seq, seg_type, seq_len FROM seg LEFT JOIN st USING (struct_id) WHERE seq_len<400 AND seg_len BETWEEN 3 AND 15""")
def short_structure_segments(spark, d):
    st = fx.chain(spark, d).groupBy("struct_id").agg(F.count("*").cast("int").alias("seq_len"))
    return segments.short_structures(segs(spark, d), st, 400, (3, 15))


@query("his_tag_segments", f"WITH {SEG} SELECT seg_type, count(*) AS n FROM seg WHERE NOT (contains(seg_seq,'AC') AND seg_type<>'inter') GROUP BY 1")
def his_tag_segments(spark, d):
    s = segs(spark, d)
    return s.join(segments.his_tags(s, "AC").select("struct_id", "seg_idx"), ["struct_id", "seg_idx"], "left_anti").groupBy("seg_type").agg(F.count("*").alias("n"))


RATIO = SEG + """,
b AS (SELECT *, coalesce(bfactor, max(bfactor) OVER (PARTITION BY struct_id)) AS bb FROM chain),
q AS (SELECT struct_id, pos, res_icode, bb/nullif(lead(bb) OVER w,0) AS fwd, bb/nullif(lag(bb) OVER w,0) AS bwd,
 max(CASE WHEN res_icode IS NOT NULL THEN pos END) OVER (PARTITION BY struct_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pb,
 min(CASE WHEN res_icode IS NOT NULL THEN pos END) OVER (PARTITION BY struct_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pa FROM b WINDOW w AS (PARTITION BY struct_id ORDER BY pos)),
ratio AS (SELECT struct_id, pos, fwd, bwd, CASE WHEN res_icode IS NOT NULL THEN NULL WHEN pa-pos<=2 AND pos-pb<=2 THEN least(fwd,bwd) WHEN pa-pos<=2 THEN fwd WHEN pos-pb<=2 THEN bwd END AS ctx FROM q)"""


@query("bfactor_ratio_context", f"WITH {RATIO} SELECT struct_id, pos, round(fwd,6)+0.0 AS fwd, round(bwd,6)+0.0 AS bwd, round(ctx,6)+0.0 AS ctx FROM ratio")
def bfactor_ratio_context(spark, d):
    return segments.bfactor_ratios(fx.chain(spark, d), 2).select("struct_id", "pos", r("fwd"), r("bwd"), r("ctx"))


@query("bfactor_context", f"""WITH {RATIO} SELECT seg.struct_id, seg_idx, round(max(CASE WHEN pos=seg_start-1 THEN ctx END),6)+0.0 AS m1, round(max(CASE WHEN pos=seg_start+seg_len THEN ctx END),6)+0.0 AS p1
 FROM seg JOIN ratio ON seg.struct_id=ratio.struct_id GROUP BY ALL""")
def bfactor_context(spark, d):
    c = fx.chain(spark, d)
    return segments.segment_context(segments.bfactor_ratios(c, 2), segments.segments(c), 1, "ctx").select("struct_id", "seg_idx", r("m1"), r("p1"))


@query("bfactor_ecdf", f"""WITH {fx.CHAIN}, e AS (SELECT struct_id, pos, cume_dist() OVER (PARTITION BY struct_id ORDER BY bfactor) AS e FROM chain WHERE bfactor IS NOT NULL)
SELECT c.struct_id, c.pos, round(e.e,9) AS ecdf FROM chain c LEFT JOIN e ON c.struct_id=e.struct_id AND c.pos=e.pos""")
def bfactor_ecdf(spark, d):
    return segments.ecdf(fx.chain(spark, d), "bfactor", ["struct_id"]).select("struct_id", "pos", r("ecdf", 9))


@query("ecdf_at", f"""WITH {fx.CHAIN}, q AS (SELECT DISTINCT struct_id, CAST(10*k AS DOUBLE) AS bfactor FROM chain, range(0,11) t(k)),
s AS (SELECT struct_id, bfactor, count(*) OVER (PARTITION BY struct_id) AS n FROM chain WHERE bfactor IS NOT NULL)
SELECT q.struct_id, q.bfactor, round(sum(CASE WHEN s.bfactor<=q.bfactor THEN 1 ELSE 0 END)/max(n),9)+0.0 AS ecdf FROM q JOIN s ON q.struct_id=s.struct_id GROUP BY 1,2""")
def ecdf_at(spark, d):
    c = fx.chain(spark, d)
    has = c.where("bfactor IS NOT NULL").select("struct_id").distinct()
    q = has.select("struct_id", F.explode(F.array(*[F.lit(10.0 * k) for k in range(11)])).alias("bfactor"))
    return segments.ecdf_at(c, q, "bfactor", ["struct_id"]).select("struct_id", "bfactor", r("ecdf", 9))


@query("runs", f"""WITH {fx.CHAIN}, f AS (SELECT *, CASE WHEN contact_count IS NOT DISTINCT FROM lag(contact_count) OVER w THEN 0 ELSE 1 END AS c FROM chain WINDOW w AS (PARTITION BY struct_id ORDER BY pos)),
n AS (SELECT *, sum(c) OVER (PARTITION BY struct_id ORDER BY pos) AS run FROM f) SELECT struct_id, min(pos) AS start, min(contact_count) AS value, count(*) AS length FROM n GROUP BY struct_id, run""")
def q_runs(spark, d):
    return segments.runs(fx.chain(spark, d), "contact_count")


ZERO = fx.CHAIN + """, z AS (SELECT *, pos - row_number() OVER (PARTITION BY struct_id ORDER BY pos) AS g FROM chain WHERE contact_count=0),
zr AS (SELECT struct_id, min(pos) AS start, count(*) AS length, string_agg(res_name,'' ORDER BY pos) AS seq FROM z GROUP BY struct_id, g)"""


@query("zero_contact_runs", f"WITH {ZERO} SELECT zr.*, n AS chain_length FROM zr JOIN (SELECT struct_id, count(*) AS n FROM chain GROUP BY 1) c USING (struct_id) WHERE length>=2")
def zero_contact_runs(spark, d):
    return segments.zero_runs(fx.chain(spark, d))


@query("run_length_hist", f"WITH {ZERO} SELECT 0::BIGINT AS length, (SELECT count(*) FROM chain WHERE contact_count<>0) AS n UNION ALL SELECT length, count(*) FROM zr GROUP BY 1")
def run_length_hist(spark, d):
    return segments.run_length_hist(fx.chain(spark, d), "contact_count", 0)


@query("sequence_gaps", f"""WITH {fx.CHAIN}, z AS (SELECT *, pos - row_number() OVER (PARTITION BY struct_id ORDER BY pos) AS g FROM chain WHERE res_name='X'),
e AS (SELECT struct_id, min(pos) AS first_pos, max(pos) AS last_pos FROM chain GROUP BY 1)
SELECT z.struct_id, min(pos) AS start, count(*) AS length, first_pos, last_pos FROM z JOIN e ON z.struct_id=e.struct_id GROUP BY z.struct_id, g, first_pos, last_pos""")
def sequence_gaps(spark, d):
    return segments.sequence_gaps(fx.chain(spark, d))


@query("unmodelled_counts", f"""WITH {fx.CHAIN}, e AS (SELECT *, min(CASE WHEN res_icode IS NULL THEN pos END) OVER (PARTITION BY struct_id) AS a, max(CASE WHEN res_icode IS NULL THEN pos END) OVER (PARTITION BY struct_id) AS b FROM chain)
SELECT struct_id, count(*) FILTER (res_icode IS NOT NULL AND pos<a) AS n_nterm, count(*) FILTER (res_icode IS NOT NULL AND pos>a AND pos<b) AS n_inter, count(*) FILTER (res_icode IS NOT NULL AND pos>b) AS n_cterm FROM e GROUP BY 1""")
def unmodelled_counts(spark, d):
    return segments.unmodelled_counts(fx.chain(spark, d))


@query("canonical_fill", f"""WITH {fx.CHAIN}, s AS (SELECT *, CASE WHEN res_icode IS NULL THEN pos*2+1 END AS s FROM chain),
f AS (SELECT *, max(s) OVER (PARTITION BY struct_id ORDER BY pos) AS p, min(s) OVER (PARTITION BY struct_id)-1 AS lead0, count(s) OVER (PARTITION BY struct_id ORDER BY pos) AS run FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY struct_id, run ORDER BY pos) - CASE WHEN run>0 THEN 2 ELSE 1 END AS k FROM f)
SELECT struct_id, pos, res_name, coalesce(p,lead0) AS seq_idx, CASE WHEN s IS NULL THEN 'U_' || lpad(CAST(k AS VARCHAR),4,'0') END AS res_icode FROM n""")
def canonical_fill(spark, d):
    c = fx.chain(spark, d)
    return segments.canonical_fill(c.select("struct_id", "pos", "res_name"), c.where("res_icode IS NULL").select("struct_id", "pos", (F.col("pos") * 2 + 1).alias("seq_idx")))


AA = fx.CHAIN + """, std AS (SELECT struct_id, pos, res_name, lead(res_name) OVER (PARTITION BY struct_id ORDER BY pos) AS nx FROM chain WHERE res_name IN ('A','C','D','E')),
cnt AS (SELECT aa, count(*) AS n FROM (SELECT res_name AS aa FROM std UNION ALL SELECT res_name||nx FROM std WHERE nx IS NOT NULL) GROUP BY 1),
fr AS (SELECT aa, n, n/sum(n) OVER (PARTITION BY length(aa)) AS freq FROM cnt)"""


@query("aa_pair_counts", f"WITH {AA} SELECT aa, n, round(freq,9) AS freq FROM fr")
def aa_pair_counts(spark, d):
    return segments.frequencies(segments.aa_counts(fx.chain(spark, d), LETTERS)).select("aa", "n", r("freq", 9))


@query("propensity_single", f"""WITH {SEG}, {AA[len(fx.CHAIN) + 2:]}, i AS (SELECT aa, count(*) AS seg_n FROM (SELECT unnest(string_split(seg_seq,'')) AS aa FROM seg) WHERE aa<>'' GROUP BY 1),
j AS (SELECT aa, seg_n, seg_n/sum(seg_n) OVER () AS seg_freq FROM i) SELECT fr.aa, fr.n, round(freq,9) AS freq, seg_n, round(seg_freq,9) AS seg_freq, round(seg_freq/freq,6) AS propensity FROM fr JOIN j USING (aa) WHERE length(fr.aa)=1""")
def propensity_single(spark, d):
    c = fx.chain(spark, d)
    return segments.propensity_single(c, segments.segments(c)).select("aa", "n", r("freq", 9), "seg_n", r("seg_freq", 9), r("propensity"))


@query("propensity_pairs", f"""WITH {SEG}, {AA[len(fx.CHAIN) + 2:]}, o AS (SELECT * FROM (VALUES (0),(1)) t(off)),
cx AS (SELECT off, 'pre' AS side, a.res_name||b.res_name AS aa FROM seg, o, chain a, chain b WHERE a.struct_id=seg.struct_id AND b.struct_id=seg.struct_id AND a.pos=seg_start-off-2 AND b.pos=seg_start-off-1
 UNION ALL SELECT off, 'post', a.res_name||b.res_name FROM seg, o, chain a, chain b WHERE a.struct_id=seg.struct_id AND b.struct_id=seg.struct_id AND a.pos=seg_start+seg_len+off AND b.pos=seg_start+seg_len+off+1),
c AS (SELECT off, side, aa, count(*) AS n FROM cx GROUP BY ALL), l AS (SELECT * FROM (VALUES ('A'),('C'),('D'),('E')) t(x)),
g AS (SELECT off, side, a.x||b.x AS aa FROM o, (VALUES ('pre'),('post')) s(side), l a, l b),
j AS (SELECT g.off, g.side, g.aa, coalesce(n,0)::BIGINT AS n FROM g LEFT JOIN c USING (off, side, aa)),
k AS (SELECT *, n/nullif(sum(n) OVER (PARTITION BY off, side),0) AS freq FROM j)
SELECT off, side, k.aa, k.n, round(k.freq,9) AS freq, round(k.freq/fr.freq,6) AS propensity FROM k LEFT JOIN fr ON k.aa=fr.aa""")
def propensity_pairs(spark, d):
    c = fx.chain(spark, d)
    return segments.propensity_pairs(c, segments.segments(c), (0, 1), LETTERS).select("off", "side", "aa", "n", r("freq", 9), r("propensity"))


WINDOWS = fx.CHAIN + """, w0 AS (SELECT *, (res_name IN ('A','C','D','E') AND res_hflag IS NULL AND res_icode IS NULL) AS ok FROM chain)"""


def _window_sql(c: int) -> str:
    w = 2 * c + 1
    return f"""SELECT {c} AS context, max(contact_count) OVER (PARTITION BY struct_id ORDER BY pos ROWS BETWEEN {c} FOLLOWING AND {c + 1} FOLLOWING) AS smax,
 count(*) OVER s AS n, min(ok) OVER s AS g, {w + 1} AS w FROM w0 WINDOW s AS (PARTITION BY struct_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING)"""


@query("contact_windows_sweep", f"""WITH {WINDOWS}, a AS ({_window_sql(0)} UNION ALL {_window_sql(1)} UNION ALL {_window_sql(2)}), b AS (SELECT context, smax FROM a WHERE n=w AND g)
SELECT context, bound, count(*) FILTER (smax<=bound) AS n FROM b CROSS JOIN (VALUES (0.0::DOUBLE),(1.0::DOUBLE)) t(bound) GROUP BY ALL""")
def contact_windows_sweep(spark, d):
    c = fx.chain(spark, d).withColumnRenamed("contact_count", "contact_smax")
    return segments.contact_window_sweep(segments_only(c), [0, 1, 2], [0.0, 1.0])


def segments_only(c):
    return c.withColumn("res_name", F.when(F.col("res_name").isin(LETTERS), F.col("res_name")).otherwise("X"))


@query("neighbourhood_filter", f"""WITH {fx.CHAIN}, w AS (SELECT struct_id, pos, count(*) OVER s AS n, count(bfactor) OVER s AS m FROM chain WINDOW s AS (PARTITION BY struct_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT struct_id, pos FROM w WHERE n=5 AND m=5""")
def neighbourhood_filter(spark, d):
    return segments.neighbourhood_filter(fx.chain(spark, d), 2, ["bfactor"]).select("struct_id", "pos")


@query("bfactor_density", f"""WITH {fx.RESIDUES}, b AS (SELECT secondary, least(width_bucket(bfactor,0,100,50),50)::INT AS bin FROM residues WHERE bfactor BETWEEN 0 AND 100),
n AS (SELECT secondary, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT secondary, bin, n, round(n/sum(n) OVER (PARTITION BY secondary),9) AS p, round(sum(n) OVER (PARTITION BY secondary ORDER BY bin)/sum(n) OVER (PARTITION BY secondary),9) AS cdf FROM n""".replace("least(width_bucket(bfactor,0,100,50),50)::INT", "least(floor(bfactor/2)+1,50)::INT"))
def bfactor_density(spark, d):
    return frequency.binned_density(fx.residues(spark, d), "bfactor", ["secondary"], 0.0, 100.0, 50).select("secondary", "bin", "n", r("p", 9), r("cdf", 9))


# --- structures ---------------------------------------------------------------------------------------------------


@query("metadata_search", f"""WITH {fx.STRUCTS} SELECT DISTINCT unp_id FROM structs WHERE (resolution<=1.8 AND src_org='BUILDING') OR (deposition_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND NOT method='O' AND seq_len>=100)""")
def metadata_search(spark, d):
    m = metadata
    p = m.any_of(m.all_of(m.resolution_at_most(1.8), m.expression_system("BUILDING")), m.all_of(m.deposited("1995-01-01", "1996-12-31"), m.where("method", "equals", "O", negate=True), m.where("seq_len", "greater_or_equal", 100)))
    return m.search(fx.structs(spark, d), p, "unp_id")


@query("full_text_search", f"WITH {fx.STRUCTS} SELECT method, count(*) AS n FROM structs WHERE lower(concat_ws(chr(31), src_org, method)) LIKE '%mach%' GROUP BY 1")
def full_text_search(spark, d):
    return metadata.full_text(fx.structs(spark, d), "MACH").groupBy("method").agg(F.count("*").alias("n"))


@query("text_predicates", """SELECT lang, count(*) FILTER (contains(lower(text),'idiot')) AS phrase, count(*) FILTER (regexp_matches(lower(text),'(^|\\W)(clown|scum)(\\W|$)')) AS words FROM documents GROUP BY 1""")
def text_predicates(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count_if(metadata.where("text", "contains_phrase", "idiot")).alias("phrase"), F.count_if(metadata.where("text", "contains_words", "clown scum")).alias("words"))


@query("rejection_report", f"""WITH {fx.STRUCTS}, b AS (SELECT NOT resolution<=2.5 AS a, NOT seq_len>=90 AS b, NOT method<>'F' AS c FROM structs)
SELECT 'resolution' AS filter, count(*) FILTER (a) AS n FROM b UNION ALL SELECT 'length', count(*) FILTER (b) FROM b UNION ALL SELECT 'method', count(*) FILTER (c) FROM b
UNION ALL SELECT 'rejected', count(*) FILTER (a OR b OR c) FROM b UNION ALL SELECT 'total', count(*) FROM b""")
def rejection_report(spark, d):
    return metadata.rejection_report(fx.structs(spark, d), reject_filters())[1]


@query("rejected_by", f"""WITH {fx.STRUCTS} SELECT coalesce(CASE WHEN method='F' THEN 'method' WHEN seq_len<90 THEN 'length' WHEN resolution>2.5 THEN 'resolution' END,'kept') AS rejected_by, count(*) AS n FROM structs GROUP BY 1""")
def rejected_by(spark, d):
    return metadata.rejection_report(fx.structs(spark, d), reject_filters())[0].groupBy(F.coalesce("rejected_by", F.lit("kept")).alias("rejected_by")).agg(F.count("*").alias("n"))


def reject_filters():
    return [("resolution", F.col("resolution") <= 2.5), ("length", F.col("seq_len") >= 90), ("method", F.col("method") != "F")]


@query("reference_pick", f"""WITH {fx.STRUCTS} SELECT unp_id, arg_min(struct_id,(resolution,struct_id)) FILTER (seq_len/unp_len BETWEEN 0.9 AND 1.1) AS ref_id, min(resolution) FILTER (seq_len/unp_len BETWEEN 0.9 AND 1.1) AS ref_resolution,
 count(*) AS group_size, round(median(resolution),6) AS group_median FROM structs GROUP BY 1 HAVING min(resolution) FILTER (seq_len/unp_len BETWEEN 0.9 AND 1.1) IS NOT NULL""")
def reference_pick(spark, d):
    return metadata.pick_reference(fx.structs(spark, d)).select("unp_id", "ref_id", "ref_resolution", "group_size", r("group_median"))


@query("chains_to_collect", """SELECT o_custkey AS entry_id, o_orderstatus AS entity_id, min(o_orderkey) AS chain_id FROM orders GROUP BY 1,2""")
def chains_to_collect(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderstatus").alias("entity_id"), F.col("o_orderkey").alias("chain_id"), F.array("o_orderkey").alias("unp_ids"))
    return metadata.chains_to_collect(o, single_per_entity=True).select("entry_id", "entity_id", "chain_id")


# --- contacts -----------------------------------------------------------------------------------------------------

CONTACTS = fx.ATOMS + """, p AS (SELECT a.atom_id AS src, b.atom_id AS tgt, a.chain AS sc, b.chain AS tc, sqrt(0.0+(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM atoms a JOIN atoms b ON a.atom_id<>b.atom_id),
rc AS (SELECT src, tgt, sc, tc, dist, CASE WHEN tgt%10=0 THEN 'LIG' WHEN sc<>tc THEN 'OOC' ELSE 'AA' END AS kind FROM p WHERE dist<=5)"""


def near(spark, d):
    return contacts.radius_contacts(fx.atoms(spark, d), 5.0, ligand=F.col("atom_id") % 10 == 0)


@query("radius_contacts", f"WITH {CONTACTS} SELECT src, tgt, sc AS src_chain, tc AS tgt_chain, round(dist,6) AS dist, kind FROM rc")
def radius_contacts(spark, d):
    return near(spark, d).select("src", "tgt", "src_chain", "tgt_chain", r("dist"), "kind")


@query("residue_contacts", f"""WITH {CONTACTS} SELECT src, count(*) AS contact_count, max(CASE WHEN kind='AA' THEN abs(src-tgt) END) AS contact_smax, count(*) FILTER (kind='OOC') AS n_ooc, count(*) FILTER (kind='LIG') AS n_non_aa, round(min(dist),6) AS dist_min FROM rc GROUP BY 1""")
def residue_contacts(spark, d):
    return contacts.residue_contacts(near(spark, d)).select("src", "contact_count", "contact_smax", "n_ooc", "n_non_aa", r("dist_min"))


#: Edges with waters, bases (names of two letters), edges that are proximal only, and edges that interact with water.
EDGES = CONTACTS + """, nm AS (SELECT *, CASE WHEN src%13=0 THEN 'HOH' WHEN src%7=0 THEN 'DA' ELSE 'ALA' END AS sr, CASE WHEN tgt%13=0 THEN 'HOH' WHEN tgt%7=0 THEN 'DA' ELSE 'ALA' END AS tr FROM rc WHERE src<tgt),
e AS (SELECT * FROM nm WHERE (src+tgt)%5<>0 AND (src*3+tgt)%11<>0 AND sr<>'HOH' AND tr<>'HOH'),
b AS (SELECT src, tgt, sc, tc, sr, tr, dist FROM e UNION ALL SELECT tgt, src, tc, sc, tr, sr, dist FROM e)"""


@query("interaction_summary", f"""WITH {EDGES} SELECT sc AS s_chain, src AS s_seq, sr AS s_res, count(*) AS contact_count, round(min(dist),6) AS dist_min, round(max(dist),6) AS dist_max, min(CASE WHEN sc=tc THEN abs(src-tgt) END) AS seq_min, max(CASE WHEN sc=tc THEN abs(src-tgt) END) AS seq_max,
 count(DISTINCT CASE WHEN sc<>tc THEN tc END)::INT AS n_ooc, coalesce(string_agg(DISTINCT CASE WHEN tr='DA' THEN tc || ':DA' || tgt END, ' ' ORDER BY CASE WHEN tr='DA' THEN tc || ':DA' || tgt END),'') AS non_aa, count(DISTINCT CASE WHEN tr='ALA' THEN tgt END)::INT AS n_aas,
 CASE WHEN bool_or((src+tgt)%5=1) THEN 'hbond proximal vdw' ELSE 'proximal vdw' END AS types FROM b GROUP BY 1,2,3""")
def interaction_summary(spark, d):
    name = lambda c: F.when(F.col(c) % 13 == 0, "HOH").when(F.col(c) % 7 == 0, "DA").otherwise("ALA")
    both = F.col("src") + F.col("tgt")
    kinds = F.when(both % 5 == 0, F.array(F.lit("proximal"))).when(both % 5 == 1, F.array(F.lit("vdw"), F.lit("hbond"), F.lit("proximal"))).otherwise(F.array(F.lit("vdw"), F.lit("proximal")))
    wet = F.when((F.col("src") * 3 + F.col("tgt")) % 11 == 0, "SELECTION_WATER").otherwise("INTRA_SELECTION")
    e = near(spark, d).where("src < tgt").select(F.col("src_chain").alias("bgn_chain"), F.col("src").alias("bgn_seq"), name("src").alias("bgn_res"), F.col("tgt_chain").alias("end_chain"), F.col("tgt").alias("end_seq"), name("tgt").alias("end_res"), kinds.alias("contact"), F.col("dist").alias("distance"), wet.alias("interacting"))
    s = contacts.interaction_summary(e)
    return s.select("s_chain", "s_seq", "s_res", "contact_count", r("dist_min"), r("dist_max"), "seq_min", "seq_max", F.size("contact_ooc").alias("n_ooc"), F.array_join("contact_non_aa", " ").alias("non_aa"), F.size("contact_aas").alias("n_aas"), F.array_join("contact_types", " ").alias("types"))


from . import registry_stats  # noqa: E402, F401, I001  (these register their queries here)
from . import registry_more  # noqa: E402, F401
from . import registry_io  # noqa: E402, F401
