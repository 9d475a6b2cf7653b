"""A training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.  All but the last return
the columns of `documents`; the last returns the packed pieces.  Null texts, repeated rows and empty tables are
handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm._common import temporary, written
from tandem.llm.decontaminate import clean
from tandem.llm.importance import select
from tandem.llm.near_dedup import near_duplicates
from tandem.llm.packing import cut, pack
from tandem.llm.substring_dedup import remove_repeats

#: Words of the shortest passage that is removed where it repeats.
PASSAGE = 50
#: Ids that may be broadcast once they have been counted.
BROADCAST_IDS = 1_000_000


def _as_row(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one struct, `_others`: a stage's own columns clash with none of them."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_others"))


def _restored(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """`columns` from what `_as_row` made, of which `new` are replaced."""
    old = {c: F.col(c) if c in ("doc_id", "text") else F.col("_others").getField(c) for c in columns}
    return df.select(*[new.get(c, old[c]).alias(c) for c in columns])


def _near(ids: DataFrame) -> DataFrame:
    """`ids`, broadcast once they are counted and few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; equal rows all stay or all go.

    Rows are judged by id and text, and the texts stay where they are: what is dropped is looked up.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    with temporary(spark):
        judged = select(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id", "_hash"])
        dropped = judged.where("NOT selected").select(F.col("doc_id").alias("_id"), "_hash").distinct()
        dropped = written(dropped, "dropped", outlives=1)
    is_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    columns, docs = docs.columns, _as_row(docs)
    return _restored(docs.join(_near(dropped), is_row, "left_anti"), columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id, null ids last.

    Rows are judged by id and text, so others with the id of a copy stay, and of rows that repeat both one stays.
    Documents without words are copies of nothing; all of them stay.
    """
    row, columns, docs = ["_id", "_hash"], docs.columns, _as_row(docs)
    with temporary(spark):
        found = near_duplicates(docs, shingle=5, percent=80).where("component IS NOT NULL")
        rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.any_value("component").alias("component"), F.count("*").alias("n"))
        rows = written(rows, "rows")
        first = rows.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("null"), *row)).alias("first")).select("first.*")
        same = F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_hash") == F.col("k_hash"))
        judged = rows.join(first.select(*[F.col(c).alias(f"k{c}") for c in row]), same, "left").where("n > 1 OR k_hash IS NULL")
        judged = written(judged.select(*row, F.col("k_hash").isNull().alias("gone")), "judged", outlives=1)
    is_row = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    single = docs.join(_near(judged), is_row, "left_anti")
    repeated = docs.join(_near(judged.where("NOT gone")), is_row).dropDuplicates(row)
    return _restored(single.unionByName(repeated.select(*docs.columns)), columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those of which nothing stays go. n_chars, if there, is that of the new text."""
    cut_docs = remove_repeats(_as_row(docs), k=PASSAGE).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") == 0, F.col("_others.n_chars")).otherwise(F.length("kept_text"))
        new["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return _restored(cut_docs, docs.columns, **new)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, share=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack(cut(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0), capacity=2048)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

#: SQL can express neither the hashed models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
