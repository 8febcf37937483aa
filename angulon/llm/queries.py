"""The registered query of each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, code_switch, fingerprints, flac, lines, maxent, mixing, order_minhash, quality, ranked, toxicity, urls, whitening
from .shared import documents, id_remainder


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every taken copy of every document, sources mixed to 0.95 of the entropy of equal weights, at most 4 passes."""
    return mixing.realised(documents(spark, sf_dir))


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; ids with crc32 mod 7 = 2 are held out of the training."""
    docs = documents(spark, sf_dir)
    model, counts = maxent.train(docs.where(id_remainder("doc_id", 7) != 2))
    df = maxent.score(docs, model, counts)
    return df.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: the least id in it."""
    docs = documents(spark, sf_dir)
    found = order_minhash.classes_of(docs)
    return found.select("doc_id", "class_id", "kept")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next one's."""
    df = fingerprints.with_whole_edits(documents(spark, sf_dir))
    df = fingerprints.add_likeness(df, "sketch", "edited_sketch", "near_edited", whole=True)
    df = fingerprints.add_likeness(df, "sketch", "next_sketch", "near_next", whole=True)
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.fingerprint("sketch").alias("fingerprint"),
        fingerprints.fingerprint("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "next_id",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of ids with crc32 mod 4 = 2 are never learnt from."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(id_remainder("doc_id", 4) != 2))
    score = docs.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), toxicity.score_column(F.col("text"), model, spark).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload stored as a FLAC stream and read back."""
    return documents(spark, sf_dir).select("doc_id", flac.digest_column(F.col("text")).alias("d")).select("doc_id", "d.*")


#: Host, path and verdict of each rule; the longest that fits a URL wins.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL by URL_RULES; a URL that none fits is allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of ids with crc32 mod 4 = 2 are never learnt from."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(id_remainder("doc_id", 4) != 2))
    score = docs.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), quality.score_column(F.col("text"), model, spark).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines it keeps; documents that keep none are left out."""
    return lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text and the text decoded from them, as digests."""
    import public_tokenizers

    docs = documents(spark, sf_dir)
    return docs.select("doc_id", bpe.digest_column(F.col("text"), public_tokenizers.path("word_bpe_49k.json"), spark).alias("d")).select("doc_id", "d.*")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_code_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; ids with crc32 mod 4 = 2 are never learnt from."""
    docs = documents(spark, sf_dir)
    model = code_switch.train(docs.where(id_remainder("doc_id", 4) != 2))
    lang, score = code_switch.predict_columns(F.col("text"), model, spark)
    return docs.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), lang.alias("lang_pred"), score.alias("score"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item."""
    return ranked.rank_all(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_mixing": op1_mixing, "op2_maxent": op2_maxent, "op3_order_minhash": op3_order_minhash, "op4_syncmers": op4_syncmers, "op5_url_filter": op5_url_filter, "op6_quality": op6_quality, "op7_line_dedup": op7_line_dedup, "op8_bpe": op8_bpe, "op9_toxicity": op9_toxicity, "op10_flac": op10_flac, "op11_whitening": op11_whitening, "op12_code_switch": op12_code_switch, "op13_ranked": op13_ranked}
QUERY_SQL: dict[str, str] = {
    "op5_url_filter": r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, s, v)),
best AS (
  SELECT host, path, max_by(h || s, length(h || s)) AS rule, max_by(v, length(h || s)) AS v
  FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, s)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.v, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path""",
    "op13_ranked": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, nd),
m AS (SELECT r, 50 + (50 * CAST(len(terms) AS BIGINT) * nd) // total AS m FROM d, s WHERE len(terms) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM p WHERE score > 0) WHERE rank <= 50""",
}
