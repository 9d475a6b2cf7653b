"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.llm.credentials import KINDS, scan, written_spans


def op12_credential_links(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


QUERIES = {"op12_credential_links": op12_credential_links}
SQL: dict[str, str] = {}
