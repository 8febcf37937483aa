"""From raw documents to token ids, in five stages, each on all that its predecessor kept.

Every stage takes and (but for the last) returns the columns of documents; each decision takes effect: documents that
the quality classifier rejects go, lines that others repeat go (n_chars follows the text), one document of each
near-duplicate class stays, sources are mixed to even out their shares (documents may come more than once), and the
last stage returns the ids of every text. There is no SQL for it; the tests compare it with a plain version.

Null ids and texts pass through every stage (a null text is scored as the empty one); repeated rows of id and text are
one document from line dedup on; empty tables give empty tables; extra columns may have any names and are kept until
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from angulon.llm import bpe, lines, mixing, order_minhash, quality
from angulon.llm.shared import documents, id_remainder, stored

#: Scores below this are rejected.
ACCEPT = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on labelled rows of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_remainder("doc_id", 4) != 2)
    model = quality.train(docs, labels)
    return docs.where(quality.score_column(F.col("text"), model, spark) >= ACCEPT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy line dedup."""
    return lines.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order MinHash near-dedup."""
    return order_minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing to 0.95 of the entropy of equal weights, at most 4 passes over a source."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and the digest of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    made = docs.select("doc_id", "source", bpe.encode_digest_column(F.col("text"), path, spark).alias("d"))
    return made.select("doc_id", "source", F.size("d.ids").cast("bigint").alias("n_tokens"), "d.ids", "d.decoded_sha256")


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline_{name}")
    return docs


QUERIES = {"pipeline": run}
QUERY_SQL = {"pipeline": ORACLE_SQL}
