"""Bags of words, vocabularies and tf-idf over cells (item_id, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators._shared import written

#: Counted features that are broadcast; more are joined by a shuffle.
BROADCAST_FEATURES = 1_000_000


def bow(tokens: DataFrame, item: str = "doc_id", token: str = "token") -> DataFrame:
    return tokens.groupBy(F.col(item).alias("item_id"), F.col(token).alias("feature")).agg(F.count("*").cast("double").alias("value"))


def build_vocab(cells: DataFrame) -> DataFrame:
    """token, df and cf. The token itself is the key; `with_ids` numbers them where a contract needs numbers."""
    return cells.groupBy(F.col("feature").alias("token")).agg(F.count("*").alias("df"), F.sum("value").alias("cf"))


def with_ids(df: DataFrame, order: list[str], name: str = "feature", base: int = 0) -> DataFrame:
    """Dense ids in the given order without one task that sees all rows: range parts, their counts, local ranks.

    The parts are written once: counts and ranks have to come from the same cuts, which Spark draws from a sample.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")
    local = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_rank") - 1 + base).cast("long")).drop("_part", "_rank", "_start")


def apply_frozen_vocab(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Only tokens that the vocabulary knows; Spark broadcasts it while it is under its threshold."""
    return tokens.join(vocab.select(F.col("token").alias(token)), token, "left_semi")


def idf(df: Column, n: Column | float) -> Column:
    return F.log2(F.lit(n) / df) if not isinstance(n, Column) else F.log2(n / df)


def document_frequencies(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feature").agg(F.count("*").alias("df"))


def _with_frequencies(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells, written once, and their features' frequencies: broadcast if few, else hashed where they meet the cells, so none are sorted."""
    cells = written(cells, "cells")
    df = written(document_frequencies(cells), "frequencies")
    return cells, F.broadcast(df) if df.count() <= BROADCAST_FEATURES else df.hint("shuffle_hash")


def tfidf(cells: DataFrame, n_items: int, normalize: bool = True, frequencies: DataFrame | None = None, eps: float = 1e-12) -> DataFrame:
    """tf * log2(N / df), cells of no weight dropped, then divided by the item's L2 norm if asked for.

    Cells whose frequencies have to be counted are written once, so texts aren't split twice; the frequencies are
    broadcast if at most `BROADCAST_FEATURES` were counted.
    """
    cells, df = _with_frequencies(cells.select("item_id", "feature", "value")) if frequencies is None else (cells, frequencies)
    out = cells.join(df, "feature").withColumn("value", F.col("value") * idf(F.col("df"), float(n_items))).drop("df").where(F.abs("value") > eps)
    if normalize:
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("item_id")))
        out = out.withColumn("value", F.col("value") / norm)
    return out.select("item_id", "feature", "value")


def feature_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feature").agg(F.sum("value").alias("total"))


def retained_features(cells: DataFrame, k: int, discard_top: int = 0) -> DataFrame:
    """Features ranked discard_top .. k-1 by their sum: feature, total, new_feature (from 0). A bounded top-k."""
    top = feature_totals(cells).orderBy(F.desc("total"), "feature").limit(k)
    ranked = top.withColumn("new_feature", F.row_number().over(Window.orderBy(F.desc("total"), "feature")) - 1 - discard_top)
    return ranked.where("new_feature >= 0")


def top_features(cells: DataFrame, k: int, discard_top: int = 0) -> DataFrame:
    """Cells of the retained features, recoded; the feature table has k rows at most."""
    kept = retained_features(cells, k, discard_top).select("feature", "new_feature")
    return cells.join(F.broadcast(kept) if k <= 100_000 else kept, "feature").select("item_id", F.col("new_feature").alias("feature"), "value")


def recode_vocab(vocab: DataFrame, keymap: DataFrame) -> DataFrame:
    """Vocabulary restricted to the retained features, with their new ids."""
    return vocab.join(keymap.select(F.col("feature").alias("token"), "new_feature"), "token")


def top_cells(cells: DataFrame, k: int) -> DataFrame:
    """The k largest cells of each item; ties go to the smaller feature."""
    order = Window.partitionBy("item_id").orderBy(F.desc("value"), "feature")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vocabulary_view(cells: DataFrame, k: int, min_freq: float = 0.001) -> DataFrame:
    """The k largest cells of each item that reach `min_freq`; smaller ones rank behind all of these, so they are dropped before anything is sorted."""
    return top_cells(cells.where(F.col("value") >= min_freq), k)


def compare_representations(tables: dict[str, DataFrame]) -> DataFrame:
    """Several tables of cells side by side, 0 where a cell is absent; one aggregation, no chain of outer joins."""
    named = [t.select("item_id", "feature", F.lit(n).alias("_name"), "value") for n, t in tables.items()]
    rows = named[0]
    for t in named[1:]:
        rows = rows.unionByName(t)
    sums = [F.coalesce(F.sum(F.when(F.col("_name") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in tables]
    return rows.groupBy("item_id", "feature").agg(*sums)


def compare_weights(cells: DataFrame, n_items: int, eps: float = 1e-12) -> DataFrame:
    """plain, weighted and normalised of each cell, as `tfidf` gives them, 0 where it drops one: columns of one table, which is split and sent once."""
    cells, df = _with_frequencies(cells.select("item_id", "feature", F.col("value").alias("plain")))
    own = F.col("plain") * idf(F.col("df"), float(n_items))
    out = cells.join(df, "feature").withColumn("weighted", F.when(F.abs(own) > eps, own).otherwise(0.0))
    norm = F.sqrt(F.sum(F.col("weighted") * F.col("weighted")).over(Window.partitionBy("item_id")))
    return out.select("item_id", "feature", "plain", "weighted", F.when(F.col("weighted") != 0, F.col("weighted") / norm).otherwise(0.0).alias("normalised"))


def tfidf_kept(cells: DataFrame, n_items: int, add: float = 0.05, digits: int = 6) -> DataFrame:
    """Cells of what `tokens.tfidf_token_filter` keeps, by tf-idf weights rounded to `digits`: a word's first int(10 * (weight + add)) occurrences, so as many or all. No token is read."""
    weight = F.round("normalised", digits)
    kept = compare_weights(cells, n_items).where("weighted <> 0").withColumn("value", F.least(F.col("plain"), F.floor(10 * (weight + add)).cast("double")))
    return kept.where("value > 0").select("item_id", "feature", "value")
