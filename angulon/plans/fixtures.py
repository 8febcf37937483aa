"""Views of the driver's tables that the operators run on: as DataFrames, and as SQL for the same rows in DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset in a local session, as in tests, a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        path = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for plans that read it several times."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS struct_id",
        "l_partkey AS unp_id",
        "l_linenumber AS unp_idx",
        "l_returnflag AS aa",
        "concat(l_returnflag,'-',l_linestatus) AS codon",
        "CASE WHEN l_discount<=0.08 THEN 1.0D ELSE 0.5D END AS codon_score",
        "CASE WHEN l_tax<0.015 THEN 'H' WHEN l_tax<0.035 THEN 'E' WHEN l_tax<0.055 THEN 'T' WHEN l_tax<0.075 THEN 'S' ELSE '-' END AS secondary",
        "CAST(CAST(round(l_extendedprice*100) AS BIGINT) % 36000 AS DOUBLE)/100D-180D AS phi",
        "CAST((l_suppkey*37 + CAST(l_quantity AS BIGINT)*11 + l_orderkey*7) % 360 AS DOUBLE)-180D AS psi",
        "CASE WHEN l_tax<0.005 THEN NULL ELSE l_quantity END AS bfactor",
    )


RESIDUES = """
residues AS (SELECT l_orderkey AS struct_id, l_partkey AS unp_id, l_linenumber AS unp_idx, l_returnflag AS aa,
  concat(l_returnflag,'-',l_linestatus) AS codon,
  CASE WHEN l_discount<=0.08 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS codon_score,
  CASE WHEN l_tax<0.015 THEN 'H' WHEN l_tax<0.035 THEN 'E' WHEN l_tax<0.055 THEN 'T' WHEN l_tax<0.075 THEN 'S' ELSE '-' END AS secondary,
  CAST(CAST(round(l_extendedprice*100) AS BIGINT) % 36000 AS DOUBLE)/CAST(100 AS DOUBLE)-CAST(180 AS DOUBLE) AS phi,
  CAST((l_suppkey*37 + CAST(l_quantity AS BIGINT)*11 + l_orderkey*7) % 360 AS DOUBLE)-CAST(180 AS DOUBLE) AS psi,
  CASE WHEN l_tax<0.005 THEN NULL ELSE l_quantity END AS bfactor
  FROM lineitem),
good AS (SELECT * REPLACE (CASE secondary WHEN 'H' THEN 'HELIX' WHEN 'E' THEN 'SHEET' WHEN 'T' THEN 'TURN' WHEN 'S' THEN 'OTHER' END AS secondary)
  FROM residues WHERE secondary <> '-' AND unp_idx IS NOT NULL AND codon_score = 1 AND codon NOT IN ('ZZZ','---'))"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    modelled = "CAST(floor(value) AS BIGINT)%3"
    return (
        table(spark, sf_dir, "events")
        .withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
        .selectExpr(
            "concat('u',CAST(user_id AS STRING)) AS struct_id",
            "pos",
            "CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'D' WHEN 'error' THEN 'E' ELSE 'X' END AS res_name",
            f"CASE WHEN {modelled}=0 THEN 'U_0000' END AS res_icode",
            f"CASE WHEN {modelled}<>0 AND event_id%17=0 THEN 'H_LIG' END AS res_hflag",
            f"CASE WHEN {modelled}<>0 THEN value END AS bfactor",
            "CAST(CAST(floor(value) AS BIGINT)%2 AS INT) AS contact_count",
        )
    )


CHAIN = """
chain AS (SELECT concat('u',CAST(user_id AS VARCHAR)) AS struct_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS INT) AS pos,
  CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'D' WHEN 'error' THEN 'E' ELSE 'X' END AS res_name,
  CASE WHEN CAST(floor(value) AS BIGINT)%3=0 THEN 'U_0000' END AS res_icode,
  CASE WHEN CAST(floor(value) AS BIGINT)%3<>0 AND event_id%17=0 THEN 'H_LIG' END AS res_hflag,
  CASE WHEN CAST(floor(value) AS BIGINT)%3<>0 THEN value END AS bfactor,
  CAST(CAST(floor(value) AS BIGINT)%2 AS INT) AS contact_count
  FROM events)"""


def structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).selectExpr(
        "o_orderkey AS struct_id",
        "o_custkey AS unp_id",
        "CAST(100 + CAST(floor(o_totalprice) AS BIGINT)%300 AS DOUBLE)/100D AS resolution",
        "CAST(85 + o_orderkey%31 AS INT) AS seq_len",
        "100 AS unp_len",
        "CAST(o_orderdate AS DATE) AS deposition_date",
        "c_mktsegment AS src_org",
        "o_orderstatus AS method",
    )


STRUCTS = """
structs AS (SELECT o_orderkey AS struct_id, o_custkey AS unp_id,
  CAST(100 + CAST(floor(o_totalprice) AS BIGINT)%300 AS DOUBLE)/CAST(100 AS DOUBLE) AS resolution,
  CAST(85 + o_orderkey%31 AS INT) AS seq_len, CAST(100 AS INT) AS unp_len,
  CAST(o_orderdate AS DATE) AS deposition_date, c_mktsegment AS src_org, o_orderstatus AS method
  FROM orders JOIN customer ON o_custkey=c_custkey)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [f"CAST(embedding[{k}] AS DOUBLE)*100D AS {n}" for k, n in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS atom_id", "label AS chain", *at)


ATOMS = """
atoms AS (SELECT vec_id AS atom_id, label AS chain, CAST(embedding[1] AS DOUBLE)*CAST(100 AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE)*CAST(100 AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE)*CAST(100 AS DOUBLE) AS z FROM embeddings)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the whole texts: documents as sequences."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "tok"))


TOKENS = """
tokens AS (SELECT doc_id, CAST(p-1 AS INT) AS pos, tok FROM (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l,1) AS p
  FROM (SELECT doc_id, string_split(text,' ') AS l FROM documents)))"""


def is_reference(struct_id: str = "struct_id") -> Column:
    """The chains that all are aligned with: those whose number is divisible by 20."""
    return F.substring(struct_id, 2, 20).cast("bigint") % 20 == 0


def aligned(chains: DataFrame) -> DataFrame:
    """Chains with what the alignments below ask of one residue: gap, and near, a star beside any other residue."""
    return chains.withColumns({"gap": F.col("res_icode").isNotNull(), "near": F.coalesce(F.col("bfactor") <= 20, F.lit(False))})


def alignments(spark: SparkSession, sf_dir: str, chains: DataFrame | None = None) -> DataFrame:
    c = chain(spark, sf_dir) if chains is None else chains
    r = c.where(is_reference()).select(F.col("struct_id").alias("ref_id"), "pos", F.col("res_name").alias("ref_name"), F.col("res_icode").alias("ri"), F.col("bfactor").alias("rb"))
    q = c.select(F.col("struct_id").alias("query_id"), "pos", F.col("res_name").alias("query_name"), F.col("res_icode").alias("qi"))
    star = F.when(F.col("ri").isNotNull() | F.col("qi").isNotNull(), " ").when(F.col("ref_name") == F.col("query_name"), "*").when(F.col("rb") <= 20, "*").otherwise(".")
    return r.join(q, "pos").where("ref_id <> query_id").select("ref_id", "query_id", F.col("pos").alias("col"), "ref_name", "query_name", star.alias("star"))


ALIGNMENTS = CHAIN + """,
alignments AS (SELECT r.struct_id AS ref_id, q.struct_id AS query_id, r.pos AS col, r.res_name AS ref_name, q.res_name AS query_name,
  CASE WHEN r.res_icode IS NOT NULL OR q.res_icode IS NOT NULL THEN ' ' WHEN r.res_name=q.res_name THEN '*' WHEN r.bfactor<=20 THEN '*' ELSE '.' END AS star
  FROM chain r JOIN chain q ON r.pos=q.pos AND r.struct_id<>q.struct_id WHERE CAST(substr(r.struct_id,2) AS BIGINT)%20=0)"""
