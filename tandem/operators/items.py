"""Reshaping, filtering and splitting of items (item_id, doc_name, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.bow import with_ids
from tandem.operators.random import hash_order
from tandem.operators.scan import runs_of_all


def filter_items(items: DataFrame, predicate: Column) -> DataFrame:
    """Items that satisfy it, with new ids 0.. in the old order: old_id, new_id and the other columns."""
    return with_ids(items.where(predicate).withColumnRenamed("item_id", "old_id"), ["old_id"], "new_id")


def drop_empty_items(items: DataFrame, cells: DataFrame) -> DataFrame:
    return items.join(cells.select("item_id"), "item_id", "left_semi")


def filter_like(other: DataFrame, mapping: DataFrame) -> DataFrame:
    """The selection of one collection applied to a parallel one."""
    return other.join(mapping.select(F.col("old_id").alias("item_id"), "new_id"), "item_id").drop("item_id").withColumnRenamed("new_id", "item_id")


def reorder(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Row `position` of the result is the item that the mapping (position, item_id) names; unknown items fail."""
    joined = mapping.join(items.withColumn("_known", F.lit(True)), "item_id", "left")
    checked = F.assert_true(F.coalesce("_known", F.lit(False)), F.lit("the mapping names an unknown item"))
    return joined.where(checked.isNull()).drop("_known")


def runs(rows: DataFrame, partition: list[str], order: list[str], doc: str) -> DataFrame:
    """Add `run`, the number of the run of consecutive rows with one `doc` inside each partition; no partition: in all rows."""
    if not partition:
        return runs_of_all(rows, order, doc)
    w = Window.partitionBy(*partition).orderBy(*order)
    change = (~F.col(doc).eqNullSafe(F.lag(doc).over(w)) & (F.row_number().over(w) > 1)).cast("int")
    marked = rows.withColumn("_change", change)
    return marked.withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def aggregate_runs(rows: DataFrame, partition: list[str], order: list[str], doc: str, values: dict[str, str], average: bool = False) -> DataFrame:
    """Sum (or mean over rows) of each run; values: new name and column."""
    agg = F.avg if average else F.sum
    return runs(rows, partition, order, doc).groupBy(*partition, "run", doc).agg(*[agg(c).alias(n) for n, c in values.items()])


def aggregate_documents(cells: DataFrame, items: DataFrame, average: bool = False) -> DataFrame:
    """Cells summed by document (divided by its number of items for a mean)."""
    named = items.select("item_id", "doc_name")
    sums = cells.join(named, "item_id").groupBy("doc_name", "feature").agg(F.sum("value").alias("value"))
    if not average:
        return sums
    sizes = named.groupBy("doc_name").agg(F.count("*").alias("_n"))
    return sums.join(sizes, "doc_name").select("doc_name", "feature", (F.col("value") / F.col("_n")).alias("value"))


def split_per_feature(cells: DataFrame) -> DataFrame:
    """One item for each cell; the new key is (item_id, feature)."""
    return cells.where("value <> 0").select(F.concat_ws(":", "item_id", "feature").alias("new_item"), "item_id", "feature", "value")


def split_train_devel_test(ranked: DataFrame, n: int, test_p: float, devel_p: float, rank: str = "position") -> DataFrame:
    """`split` by position: the last int(n * test_p) rows test, int(n * devel_p) before them devel, the rest train."""
    n_test, n_devel = int(n * test_p), int(n * devel_p)
    part = F.when(F.col(rank) >= n - n_test, "test").when(F.col(rank) >= n - n_test - n_devel, "devel").otherwise("train")
    return ranked.withColumn("split", part)


def assign_batches(ranked: DataFrame, size: int, rank: str = "position", by: str = "split") -> DataFrame:
    """`batch` of each row inside its split; rows of an incomplete last batch go."""
    bounds = ranked.groupBy(by).agg(F.min(rank).alias("_first"), F.count("*").alias("_n"))
    at = F.floor((F.col(rank) - F.col("_first")) / size)
    return ranked.join(F.broadcast(bounds), by).withColumn("batch", at).where(F.col("batch") < F.floor(F.col("_n") / size)).drop("_first", "_n")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(hash_order(key, seed=seed), key)


def sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows in hash order; more than there are is an error."""
    if df.limit(n).count() < n:
        raise ValueError("the sample is larger than the population")
    return shuffled(df, key, seed).limit(n)


def uniform_steps(ranked: DataFrame, n: int, k: int, rank: str = "position") -> DataFrame:
    """From the last of n rows backwards every (n // k)-th, k of them; `step` counts them from 0."""
    step = n // k if k else 0
    if not step:
        raise ValueError("more steps than rows")
    back = F.lit(n - 1) - F.col(rank)
    return ranked.where((back % step == 0) & (back / step < k)).withColumn("step", (back / step).cast("long"))


def random_steps(df: DataFrame, k: int, key: str, seed: int) -> DataFrame:
    return shuffled(df, key, seed).limit(k)


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
