"""Queries of near-duplicate and substring dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.llm.near_dedup import near_duplicates
from tandem.llm.substring_dedup import remove_repeats


def op5_tensored_minhash(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, percent=80)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op6_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, k=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op5_tensored_minhash": op5_tensored_minhash, "op6_substring_dedup": op6_substring_dedup}
SQL: dict[str, str] = {}
