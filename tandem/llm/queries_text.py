"""Queries of language identification, exact search and the licence scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.llm.bitslice import quantised, search
from tandem.llm.langid import learn, predict
from tandem.llm.licenses import scan


def held_out():
    """crc32 of the id's text modulo 5 is 0."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op2_rank_order_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out()))
    return predict(docs, profiles).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def op3_bit_sliced_topk(spark, sf_dir):
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = search(vectors.where("id % 50 = 0"), vectors, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_license_scan(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op2_rank_order_language": op2_rank_order_language, "op3_bit_sliced_topk": op3_bit_sliced_topk, "op4_license_scan": op4_license_scan}
SQL = {"op3_bit_sliced_topk": OP3_SQL}
