"""Pooling of word embeddings over bags of words; word_vectors (word, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.embed_sums import pooled, pooled_by_id
from tandem.operators.random import hash_uniform
from tandem.operators.tokens import strip_sense_number


def _word(column: Column, lowercase: bool, strip_sense: bool) -> Column:
    column = F.lower(column) if lowercase else column
    return strip_sense_number(column) if strip_sense else column


def pool_embeddings(
    cells: DataFrame, word_vectors: DataFrame, dim: int, op: str = "avg", lowercase: bool = False, strip_sense: bool = False, vectors: DataFrame | None = None
) -> DataFrame:
    """item_id and vec over the item's distinct words; an unknown word counts as a zero row.

    word_vectors is (word, vec), or, if words share vectors, (word, vec_id), with `vectors` (vec_id, vec).
    Rows of cells are distinct by item and feature.
    """
    words = cells.select("item_id", _word(F.col("feature"), lowercase, strip_sense).alias("word"))
    words = words.distinct() if lowercase or strip_sense or vectors is None else words
    return pooled(words, word_vectors, dim, op) if vectors is None else pooled_by_id(words, word_vectors, vectors, dim, op)


def _known(cells: DataFrame, word_vectors: DataFrame) -> DataFrame:
    words = cells.select("item_id", F.col("feature").alias("word"))
    return words.join(word_vectors.select("word", F.lit(True).alias("_known")), "word", "left")


def oov_report(cells: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """One row: total, oov, oov_rate, items_without_hit."""
    per_item = _known(cells, word_vectors).groupBy("item_id").agg(F.count("*").alias("n"), F.count("_known").alias("known"))
    return per_item.agg(
        F.sum("n").alias("total"), F.sum(F.col("n") - F.col("known")).alias("oov"),
        (F.sum(F.col("n") - F.col("known")) / F.sum("n")).alias("oov_rate"), F.count_if(F.col("known") == 0).alias("items_without_hit"),
    )


def oov_words(cells: DataFrame, word_vectors: DataFrame) -> DataFrame:
    words = cells.select("item_id", F.col("feature").alias("word"))
    return words.join(word_vectors.select("word"), "word", "left_anti").distinct()


def used_vectors(cells: DataFrame, word_vectors: DataFrame) -> DataFrame:
    return word_vectors.join(cells.select(F.col("feature").alias("word")), "word", "left_semi")


def sample_word_embedding(cells: DataFrame, word_vectors: DataFrame, seed: int = 0) -> DataFrame:
    """One word of each item, drawn in proportion to its value, and its vector (null if unknown).

    Each cell waits -ln(u) / value, u being a hash of item and word; the first to come is drawn.  That is one aggregate
    that tasks merge, and items of any size need no order.  Cells of no or negative value are never drawn.
    """
    wait = F.round(-F.log(hash_uniform("item_id", "feature", seed=seed)) / F.col("value"), 12)
    drawn = cells.where("value > 0").groupBy("item_id").agg(F.min(F.struct(wait.alias("wait"), F.col("feature").alias("word")))["word"].alias("word"))
    return drawn.join(word_vectors, "word", "left").select("item_id", "word", "vec")


def embedding_matrix(vocab: DataFrame, word_vectors: DataFrame, dim: int) -> DataFrame:
    """A vector for each word of the vocabulary, zeros where it is unknown."""
    joined = vocab.join(word_vectors.withColumnRenamed("word", "token"), "token", "left")
    return joined.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)))


def token_rows_by_frequency(cells: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """Each word's vector as often as the word occurs: item_id, word, freq, copy, vec."""
    joined = cells.select("item_id", F.col("feature").alias("word"), F.col("value").cast("int").alias("freq")).where("freq > 0").join(word_vectors, "word")
    return joined.select("item_id", "word", "freq", F.explode(F.sequence(F.lit(1), "freq")).alias("copy"), "vec")
