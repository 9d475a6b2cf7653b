"""Statistics of a sparse matrix: cells (item_id, feature, value), n_items and dim counted with the empty ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators._shared import written
from tandem.operators.gram import gram
from tandem.operators.scale import scale_to_average_covariance, second_moments


def matrix_stats(cells: DataFrame, n_items: int, dim: int) -> DataFrame:
    """One row; absent cells count as 0 in min, max and the average."""
    size = float(n_items) * dim
    full = F.count("*") >= size
    low = F.when(full, F.min("value")).otherwise(F.least(F.min("value"), F.lit(0.0)))
    high = F.when(full, F.max("value")).otherwise(F.greatest(F.max("value"), F.lit(0.0)))
    return cells.agg(
        F.lit(n_items).cast("long").alias("items"), F.lit(dim).cast("long").alias("dim"), F.sum("value").alias("total"), (F.sum("value") / size).alias("avg_cell"),
        low.alias("min"), high.alias("max"), F.count_if(F.col("value") != 0).alias("nonzero"),
    )


def axis_sums(cells: DataFrame, by: str = "item_id") -> DataFrame:
    """Sum of the cells of each item, or with `by` feature of each feature; those without cells have no row."""
    return cells.groupBy(by).agg(F.sum("value").alias("total"))


def cell_histogram(cells: DataFrame, width: float = 0.01) -> DataFrame:
    """Cells by value in bins of `width`, empty bins between the ends filled with 0."""
    n = round(1 / width)
    counts = cells.groupBy(F.round(F.col("value") * n).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo IS NOT NULL")
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def nnz_histogram(cells: DataFrame, items: DataFrame | None = None, step: int = 10) -> DataFrame:
    nnz = cells.groupBy("item_id").agg(F.count_if(F.col("value") != 0).alias("nnz"))
    if items is not None:
        nnz = items.select("item_id").join(nnz, "item_id", "left").select(F.coalesce("nnz", F.lit(0)).alias("nnz"))
    return nnz.groupBy((F.col("nnz") - F.col("nnz") % step).alias("bin")).agg(F.count("*").alias("n"))


def mass_histogram(cells: DataFrame, bins: int, high: float) -> DataFrame:
    """Number of cells, and that times the bin's lower edge, for bins of 0 .. high."""
    bin_ = F.least(F.floor(F.col("value") * bins / high), F.lit(bins - 1))
    return cells.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).withColumn("mass", F.col("n") * F.col("bin") * high / bins)


def cumulative_mass(histogram: DataFrame) -> DataFrame:
    """Running share of the mass; the histogram has a bounded number of bins."""
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = histogram.agg(F.sum("mass").alias("_total"))
    return histogram.join(F.broadcast(total)).withColumn("cumulative", F.sum("mass").over(run) / F.col("_total")).drop("_total")


def mass_points(cumulative: DataFrame, shares: Sequence[float] = (0.9, 0.95)) -> DataFrame:
    return cumulative.agg(*[F.min(F.when(F.col("cumulative") >= s, F.col("bin"))).alias(f"p{round(s * 100)}") for s in shares])


def rich_histogram(cells: DataFrame, size: int, top: float, by: str = "feature") -> DataFrame:
    """For each feature (size: items) or item (size: features): zeros, mean, mean of present, share and mean at the top."""
    high = F.col("value") >= top
    return cells.groupBy(by).agg(
        (1 - F.count("*") / size).alias("zeros"), (F.sum("value") / size).alias("mean"), F.avg("value").alias("nonzero_mean"),
        (F.count_if(high) / size).alias("saturated"), F.avg(F.when(high, F.col("value"))).alias("top_mean"),
    )


def feature_values(cells: DataFrame, feature) -> DataFrame:
    return cells.where(F.col("feature") == feature).select("item_id", "value").orderBy("value", "item_id")


def pairwise_features(cells: DataFrame, features: DataFrame, metric: Callable[[], Column], n_items: int) -> DataFrame:
    """A metric over each pair (i < j) of the selected features, from the tiles of X'X; features without cells have no pair.

    metric gets columns n, sx, sy, sxx, syy, sxy of the pair, absent cells being 0.
    """
    present = features.select("feature").distinct().join(cells.select("feature").distinct(), "feature", "left_semi")
    products, moments = gram(cells, present)
    moments = written(moments, "moments")  # a row for each feature
    small = F.broadcast if moments.count() <= 100_000 else (lambda df: df)
    a = moments.select(F.col("feature").alias("i"), F.col("s").alias("sx"), F.col("ss").alias("sxx"))
    b = moments.select(F.col("feature").alias("j"), F.col("s").alias("sy"), F.col("ss").alias("syy"))
    pairs = products.withColumnRenamed("s", "sxy").join(small(a), "i").join(small(b), "j")
    return pairs.withColumn("n", F.lit(float(n_items))).select("i", "j", metric().alias("value"))


def grid_average(pairs: DataFrame) -> DataFrame:
    """One row: the average over all cells of the symmetric grid off its diagonal, and their number; missing values are left out."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return pairs.agg(F.avg(value).alias("average"), (2 * F.count(value)).alias("cells"))


def pair_mse() -> Column:
    return (F.col("sxx") - 2 * F.col("sxy") + F.col("syy")) / F.col("n")


def pair_rmse() -> Column:
    return F.sqrt(F.greatest(pair_mse(), F.lit(0.0)))


def pair_correlation() -> Column:
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return F.when(var > 0, cov / F.sqrt(var))


def column_distances(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """mse, rmse, mae, and rmse over the range and over the mean of two columns."""
    d = F.col(x) - F.col(y)
    mse = F.avg(d * d)
    span = F.greatest(F.max(x), F.max(y)) - F.least(F.min(x), F.min(y))
    return pairs.agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        F.when(span == 0, 0.0).otherwise(F.sqrt(mse) / span).alias("range_rmse"), (F.sqrt(mse) / (F.avg(F.col(x) + F.col(y)) / 2)).alias("mean_rmse"),
    )


def max_normalised_rmse(pairs: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """rmse over that of one column ascending against the other descending; null if that is 0."""
    from tandem.operators.bow import with_ids

    up = with_ids(pairs.select(x, key), [x, key], "_r").select("_r", x)
    down = with_ids(pairs.select((-F.col(y)).alias("_y"), key), ["_y", key], "_r").select("_r", (-F.col("_y")).alias(y))
    d = F.col(x) - F.col(y)
    worst = up.join(down, "_r").agg(F.sqrt(F.avg(d * d)).alias("_worst"))
    own = pairs.agg(F.sqrt(F.avg(d * d)).alias("_own"))
    return own.join(F.broadcast(worst)).select(F.when(F.col("_worst") > 0, F.col("_own") / F.col("_worst")).alias("max_rmse"))


def feature_share(cells: DataFrame) -> DataFrame:
    totals = cells.groupBy("feature").agg(F.sum("value").alias("total"))
    grand = totals.agg(F.sum("total").alias("_grand"))
    return totals.join(F.broadcast(grand)).select("feature", (F.col("total") / F.col("_grand")).alias("share"))


def correlation_matrix(cells: DataFrame, features: DataFrame, n_items: int, after_scaling: bool = False) -> DataFrame:
    cells = scale_to_average_covariance(cells, n_items) if after_scaling else cells
    return pairwise_features(cells, features, pair_correlation, n_items)


def feature_density(cells: DataFrame, n_items: int) -> DataFrame:
    return cells.where("value <> 0").groupBy("feature").agg((F.count("*") / n_items).alias("density"))


def dispersion(cells: DataFrame, n_items: int, dim: int) -> DataFrame:
    """Mean, total and mean squared deviation over all cells, absent ones being 0."""
    size = float(n_items) * dim
    s, ss = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return cells.agg((s / size).alias("mean"), (ss - s * s / size).alias("total_sq"), ((ss - s * s / size) / size).alias("mean_sq"))


def covariance_before_after(cells: DataFrame, n_items: int) -> DataFrame:
    before = second_moments(cells, n_items).withColumnRenamed("moment", "before")
    after = second_moments(scale_to_average_covariance(cells, n_items), n_items).withColumnRenamed("moment", "after")
    return before.join(after, "feature")
