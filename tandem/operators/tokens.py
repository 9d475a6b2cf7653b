"""Token projections and filters over `tokens` (doc_id, sent_no, tok_no, form, lemma, tag)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Capital letters, ASCII and Czech.
CAPITALS = "A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"


def select_column(tokens: DataFrame, column: str = "lemma") -> DataFrame:
    """Use one of the columns as the token."""
    return tokens.withColumn("token", F.col(column))


def strip_suffix(token: Column) -> Column:
    """Drop the first `_` and what follows."""
    return F.substring_index(token, "_", 1)


def strip_sense_number(token: Column) -> Column:
    """Drop a trailing hyphen and digits."""
    return F.regexp_replace(token, "-[0-9]+$", "")


def pos_filter(tokens: DataFrame, values: Sequence[str], position: int = 0, inclusive: bool = True, tag: str = "tag") -> DataFrame:
    """Keep (or drop) tokens whose tag has one of `values` at `position`."""
    hit = F.substring(tag, position + 1, 1).isin(*values)
    return tokens.where(hit if inclusive else ~hit)


def drop_capitalized(tokens: DataFrame, column: str = "token") -> DataFrame:
    return tokens.where(~F.col(column).rlike(f"^[{CAPITALS}]"))


def sentence_counts(sentences: DataFrame) -> DataFrame:
    """n_sentences of each document, empty sentences included, from all rows before any filter."""
    return sentences.groupBy("doc_id").agg((F.max("sent_no") + 1).alias("n_sentences"))


def first_sentences(tokens: DataFrame, sentences: DataFrame, k: int = 0, share: float = 0.0) -> DataFrame:
    """Tokens of the first k sentences and of the first `share` of those after them, rounded up."""
    if not share:
        return tokens.where(F.col("sent_no") < k)
    counted = tokens.join(sentence_counts(sentences), "doc_id")
    bound = k + F.ceil(F.greatest(F.col("n_sentences") - k, F.lit(0)) * share)
    return counted.where(F.col("sent_no") < bound).drop("n_sentences")


def words_from(tokens: DataFrame, prefix: DataFrame, column: str = "token") -> DataFrame:
    """All occurrences of words that occur in the document's `prefix`."""
    return tokens.join(prefix.select("doc_id", column).distinct(), ["doc_id", column], "left_semi")


def min_doc_freq(tokens: DataFrame, n: int, column: str = "token") -> DataFrame:
    """Drop words with under n occurrences in the document, unless that would empty it; one shuffle, by document."""
    own = tokens.repartition("doc_id").withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", column)))
    own = own.withColumn("_most", F.max("_n").over(Window.partitionBy("doc_id")))
    return own.where((F.col("_n") >= n) | (F.col("_most") < n)).drop("_n", "_most")


def tfidf_token_filter(tokens: DataFrame, weights: DataFrame, add: float = 0.05, column: str = "token") -> DataFrame:
    """Keep the first int(10 * (weight + add)) occurrences of each word; words without a weight go."""
    order = Window.partitionBy("doc_id", column).orderBy("sent_no", "tok_no")
    joined = tokens.join(weights.select("doc_id", column, "weight"), ["doc_id", column])
    return joined.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.floor(10 * (F.col("weight") + add))).drop("_r", "weight")


def custom_token_filter(tokens: DataFrame, predicate: Callable[[DataFrame], Column] | Column) -> DataFrame:
    return tokens.where(predicate(tokens) if callable(predicate) else predicate)


def custom_token_transform(tokens: DataFrame, fn: Callable[[Column], Column], column: str = "token") -> DataFrame:
    return tokens.withColumn(column, fn(F.col(column)))


def granularity(tokens: DataFrame, level: str = "document") -> DataFrame:
    """Add `item`, the key of the item a token belongs to: its document, its sentence, or itself."""
    keys = {"document": ["doc_id"], "sentence": ["doc_id", "sent_no"], "token": ["doc_id", "sent_no", "tok_no"]}[level]
    return tokens.withColumn("item", F.concat_ws(":", *keys))


def freqdict(tokens: DataFrame, column: str = "token") -> DataFrame:
    return tokens.groupBy(column).agg(F.count("*").alias("n"))


def top_freq(tokens: DataFrame, n: int, column: str = "token") -> DataFrame:
    return freqdict(tokens, column).orderBy(F.desc("n"), column).limit(n)


def corpus_counts(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_words"))


def valid_utf8(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.is_valid_utf8(F.col(column)))
