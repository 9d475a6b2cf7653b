"""Numeric transforms of cells (item_id, feature, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.random import hash_order, hash_uniform
from tandem.operators.scan import shrunk_gap, squish_all


def _item():
    return Window.partitionBy("item_id")


def _value(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("value", value)


def normalize_sum(cells: DataFrame, to: float = 1.0) -> DataFrame:
    total = F.sum("value").over(_item())
    return _value(cells, F.when(total == 0, F.col("value")).otherwise(F.col("value") * to / total))


def capped_constant(cells: DataFrame, max_target: float = 0.9999) -> Column | float:
    per_item = cells.groupBy("item_id").agg((F.sum("value") * max_target / F.greatest(F.max("value"), F.lit(1e-5))).alias("c"))
    return per_item.agg(F.min("c")).first()[0] or 0.0


def normalize_capped(cells: DataFrame, max_target: float = 0.9999, items: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Sums such that the largest cell is max_target; strict: an item without cells makes them 0."""
    empty = strict and items is not None and not items.join(cells, "item_id", "left_anti").isEmpty()
    return normalize_sum(cells, 0.0 if empty else capped_constant(cells, max_target))


def scale_item_max(cells: DataFrame) -> DataFrame:
    return _value(cells, F.col("value") / F.max("value").over(_item()))


def scale_global_max(cells: DataFrame, cutoff: float | None = None) -> DataFrame:
    top = max(1e-5, cells.agg(F.max("value")).first()[0] or 0.0)
    top = min(top, cutoff) if cutoff is not None else top
    return _value(cells, F.least("value", F.lit(top)) / top)


def sigmoid(x: Column, m: float = 2.0, k: float = 0.5, c: float = 1.0) -> Column:
    return m / (1 + F.exp(-k * x)) - c


def apply_fn(x: Column, fn: Callable[[Column], Column] = F.tanh, mul: float = 1.0, add: float = 0.0, outer_mul: float = 0.99975, outer_add: float = 0.0) -> Column:
    return outer_mul * fn(mul * x + add) + outer_add


def second_moments(cells: DataFrame, n: int, by: str = "feature") -> DataFrame:
    """Mean of squares by feature (n items) or by item (n features); absent cells count as 0."""
    return cells.groupBy(by).agg((F.sum(F.col("value") * F.col("value")) / n).alias("moment"))


def uniform_variance(cells: DataFrame, n_items: int) -> DataFrame:
    scaled = cells.join(second_moments(cells, n_items), "feature").where("moment > 0")
    return scaled.select("item_id", "feature", (F.col("value") * F.sqrt(1 / F.col("moment"))).alias("value"))


def scale_to_average_covariance(cells: DataFrame, n_items: int, n_features: int | None = None) -> DataFrame:
    moments = second_moments(cells, n_items)
    mean = moments.agg((F.sum("moment") / n_features) if n_features else F.avg("moment")).first()[0]
    return cells.join(moments.where("moment > 0"), "feature").select("item_id", "feature", (F.col("value") * F.sqrt(mean / F.col("moment"))).alias("value"))


def standard_scale(cells: DataFrame, n_items: int, with_mean: bool = True, with_variance: bool = True) -> DataFrame:
    """Present cells less the feature's mean over all items, divided by its population deviation (unless that is 0)."""
    stats = cells.groupBy("feature").agg((F.sum("value") / n_items).alias("m"), (F.sum(F.col("value") * F.col("value")) / n_items).alias("s"))
    dev = F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0)))
    x = F.col("value") - F.col("m") if with_mean else F.col("value")
    x = F.when(dev > 0, x / dev).otherwise(x) if with_variance else x
    return cells.join(stats, "feature").select("item_id", "feature", x.alias("value"))


def select_random_features(cells: DataFrame, k: int, seed: int = 0) -> DataFrame:
    picked = cells.select("feature").distinct().orderBy(hash_order("feature", seed=seed), "feature").limit(k)
    picked = picked.withColumn("new_feature", F.row_number().over(Window.orderBy("feature")) - 1)
    return cells.join(F.broadcast(picked) if k <= 100_000 else picked, "feature").select("item_id", F.col("new_feature").alias("feature"), "value")


def to_dense(cells: DataFrame, dim: int) -> DataFrame:
    """item_id and vec; features are 0 .. dim-1."""
    packed = cells.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature").cast("int"), "value"))).alias("m"))
    return packed.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))


def to_sparse(vectors: DataFrame, eps: float = 1e-9) -> DataFrame:
    return vectors.select("item_id", F.posexplode("vec").alias("feature", "value")).where(F.abs("value") > eps)


def retain_top(cells: DataFrame, k: int) -> DataFrame:
    order = _item().orderBy(F.desc("value"), "feature")
    return cells.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def squish(values: DataFrame, by: str | None, value: str = "value") -> DataFrame:
    """Sorted values of each group (by None: of all rows) with every gap over 1 shrunk to 1."""
    if by is None:
        return squish_all(values, value)
    order = Window.partitionBy(by).orderBy(value)
    first = F.min(value).over(Window.partitionBy(by))
    gap = shrunk_gap(F.col(value) - F.lag(value).over(order))
    stepped = values.withColumn("_gap", gap).withColumn("_first", first)
    run = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("squished", F.col("_first") + F.sum("_gap").over(run)).drop("_gap", "_first")


def relu(x: Column, floor: float = 1e-4) -> Column:
    return F.greatest(x, F.lit(floor))


def capped_relu(x: Column, cap: float = 1.0, floor: float = 1e-4) -> Column:
    return F.least(F.greatest(x, F.lit(floor)), F.lit(cap))


def masked_relu(x: Column, mask: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) * mask


def abs_tanh(x: Column) -> Column:
    return F.abs(F.tanh(x))


def n_max(cells: DataFrame, n: int) -> DataFrame:
    return cells.orderBy(F.desc("value"), "item_id", "feature").limit(n)


def zero_mask(cells: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Drop each cell with probability p."""
    return cells.where(hash_uniform("item_id", "feature", seed=seed) >= p)


def bernoulli_sample(cells: DataFrame, seed: int = 0) -> DataFrame:
    """1 with the cell's value as probability, else 0."""
    return _value(cells, (hash_uniform("item_id", "feature", seed=seed) < F.col("value")).cast("double"))


def mock_matrix(spark, n_items: int, dim: int, prob: float, lam: float, seed: int = 0) -> DataFrame:
    """A random sparse matrix: a cell is present with `prob`, its value is 1 + Poisson(lam), by inverse distribution."""
    grid = spark.range(n_items).select(F.col("id").alias("item_id"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("feature"))
    u = hash_uniform("item_id", "feature", seed=seed + 1)
    count, mass, below = F.lit(0), 1.0, 0.0
    import math

    for k in range(int(lam + 10 * math.sqrt(lam) + 10)):
        mass = math.exp(-lam) * lam**k / math.factorial(k)
        below += mass
        count = count + (u >= below).cast("int")
    return grid.where(hash_uniform("item_id", "feature", seed=seed) < prob).withColumn("value", (1 + count).cast("double"))


def one_hot(length: int, point: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (i == point).cast("double"))


def tanh_scaled(x: Column, c: float) -> Column:
    return F.tanh(x / c)


def hyperbolic(x: Column, h: float) -> Column:
    return x / (x + h)
