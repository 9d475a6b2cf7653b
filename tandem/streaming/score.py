"""Scoring of new documents by a frozen vocabulary, in a stream or in a batch with equal results.

The vocabulary is a static table.  A micro-batch is scored like any batch: its words are counted by document, joined to
the vocabulary, weighted and normalised.  Nothing is kept between micro-batches, so there is no state and no watermark;
each is written under its number, so one that is run again after a restart replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.word_counts import counted

#: Words of a vocabulary that is broadcast; the counted rows of a larger one are joined by a shuffle.
BROADCAST_WORDS = 1_000_000


def frozen_idf(vocab: DataFrame, n_items: int) -> DataFrame:
    """token and idf, log2(N / df), of a vocabulary (token, df); words of no weight are left out."""
    return vocab.select("token", F.log2(F.lit(float(n_items)) / F.col("df")).alias("idf")).where("idf > 0")


def score(documents: DataFrame, idf: DataFrame) -> DataFrame:
    """doc_id and weights (word to normalised tf-idf) of documents (doc_id, text), a row for each row. Null text: empty."""
    small = F.broadcast(idf) if idf.count() <= BROADCAST_WORDS else idf
    item = F.struct(F.monotonically_increasing_id().alias("_row"), "doc_id").alias("item_id")
    rows = documents.select(item, F.lower(F.translate("text", ".,\n", "   ")).alias("line"))
    counts = counted(rows, together=False, whole=True).select("item_id", F.col("feature").alias("token"), F.col("value").alias("n"))
    weighted = counts.join(small, "token", "left").where("idf IS NOT NULL OR token IS NULL").withColumn("w", F.col("n") * F.col("idf"))
    known = F.when(F.col("w").isNotNull(), F.struct("token", "w"))
    listed = weighted.groupBy("item_id").agg(F.array_sort(F.collect_list(known)).alias("c"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return listed.select("item_id.doc_id", F.map_from_entries(F.transform("c", lambda x: F.struct(x["token"], x["w"] / F.col("norm")))).alias("weights"))


def score_stream(documents: DataFrame, idf: DataFrame, path: str, checkpoint: str, **trigger):
    """Start scoring a stream of documents into Parquet files under `path`, a folder `batch=<number>` for each micro-batch; returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch, idf).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.select("doc_id", "text").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
