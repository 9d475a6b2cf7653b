"""Query of the quality classifier."""

from __future__ import annotations

from tandem.llm.importance import select


def op1_importance_resampling(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return select(docs, labels)


QUERIES = {"op1_importance_resampling": op1_importance_resampling}
SQL: dict[str, str] = {}
