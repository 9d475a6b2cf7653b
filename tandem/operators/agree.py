"""Annotation algebra: (id, text, images, user, time, appropriate, inappropriate, ...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators._shared import MAX_LISTED, bounded


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, value)


def group_by(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key as an array; a key with more than `MAX_LISTED` rows is an error, as an array is held whole."""
    bounded(df, [key], MAX_LISTED)
    return df.groupBy(key).agg(F.collect_list(F.struct("*")).alias("rows"))


def counts_by_len(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"n_{column}", F.greatest(F.size(column), F.lit(0)))


def count_by_len(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(F.greatest(F.size(column), F.lit(0))).alias("n"))


def apply_on_columns(df: DataFrame, columns: Sequence[str], fn: Callable[..., Column], name: str) -> DataFrame:
    return df.withColumn(name, fn(*[F.col(c) for c in columns]))


def combined(df: DataFrame) -> DataFrame:
    return df.withColumn("combined", F.concat("appropriate", "inappropriate"))


def unannotated(df: DataFrame) -> DataFrame:
    """Offered images that were not annotated, order and repeats kept; needs `combined`."""
    return df.withColumn("unannotated", F.filter("images", lambda x: ~F.array_contains("combined", x)))


def filter_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.where(F.col("label").isin(*labels))


def filter_suspicious(df: DataFrame, n: int, column: str = "inappropriate") -> DataFrame:
    """Rows with under n images in `column` (inappropriate or combined)."""
    return df.where(F.size(column) < n)


def filter_report(df: DataFrame, labels: Sequence[str], n: int, column: str = "inappropriate") -> DataFrame:
    """One row: rows, and how many of them both filters keep and drop; a null label or set is dropped."""
    keeps = F.coalesce(F.col("label").isin(*labels) & (F.size(column) < n) & F.col(column).isNotNull(), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(keeps).alias("kept"), F.count_if(~keeps).alias("dropped"))


def totals(df: DataFrame, by: str | None = None) -> DataFrame:
    """Numbers and averages overall (by null) and, with `by`, of each user, in one pass."""
    a, i = F.size("appropriate"), F.size("inappropriate")
    aggs = [
        F.count("*").alias("items"), F.avg(F.size("images")).alias("images_per_item"), F.sum(a).alias("appropriate"),
        F.sum(i).alias("inappropriate"), F.avg(a).alias("avg_appropriate"), F.avg(i).alias("avg_inappropriate"),
    ]
    return df.rollup(by).agg(*aggs) if by else df.agg(*aggs)


def _hits(p: Column, t: Column) -> Column:
    return F.size(F.filter(p, lambda x: F.array_contains(t, x)))


def precision(p: Column, t: Column) -> Column:
    return F.when(F.size(p) == 0, 1.0).otherwise(_hits(p, t) / F.size(p))


def recall(p: Column, t: Column) -> Column:
    return F.when(F.size(t) == 0, 1.0).otherwise(_hits(p, t) / F.size(t))


def f_score(p: Column, t: Column, w_prec: float = 1.0, w_rec: float = 1.0) -> Column:
    a, b = precision(p, t), recall(p, t)
    return F.when((a == 0) | (b == 0), 0.0).otherwise((w_prec + w_rec) * a * b / (w_rec * b + w_prec * a))


def kappa(a: Column, b: Column, length: int = 12, variant: str = "reference") -> Column:
    """Agreement over chance of two choices out of `length`.

    cohen: repeated marks count once, and certain agreement is 1.  reference: repeated marks count, agreement is
    divided by 2 * length, and the value is 0 where chance is certain.
    """
    own = variant == "reference"
    x, y = (F.size(c if own else F.array_distinct(c)) for c in (a, b))
    both = _hits(b, a) if own else F.size(F.array_intersect(a, b))
    observed = (both + length - (x + y - both)) / (2 * length if own else length)
    chance = (x / length) * (y / length) + (1 - x / length) * (1 - y / length)
    return F.when(chance == 1, 0.0 if own else 1.0).otherwise((observed - chance) / (1 - chance))


def mutual_precision(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.5).otherwise((_hits(a, b) / F.size(a) + _hits(b, a) / F.size(b)) / 2)


def group_mutual_precision(df: DataFrame, column: str, by: str = "text") -> DataFrame:
    """Mean over all unordered pairs of each group; none and perfect mark groups without or with full agreement."""
    x = df.select(by, F.col("id").alias("_i"), F.col(column).alias("_x"))
    y = df.select(by, F.col("id").alias("_j"), F.col(column).alias("_y"))
    pairs = x.join(y, by).where("_i < _j").select(by, mutual_precision(F.col("_x"), F.col("_y")).alias("_m"))
    return pairs.groupBy(by).agg(F.avg("_m").alias("agreement"), F.count("*").alias("pairs")).withColumns({"none": F.col("agreement") == 0, "perfect": F.col("agreement") == 1})


def agreement_grid(df: DataFrame, column: str, metric: Callable[[Column, Column], Column], by: str = "user", on: str = "text", skip_identical: bool = True) -> DataFrame:
    """Mean of the metric over all pairs of rows of two users on the same text: u1, u2, value, pairs, size1, size2."""
    pick = lambda s: df.select(F.col(on).alias("_on"), F.col("id").alias(f"_id{s}"), F.col(by).alias(f"u{s}"), F.col(column).alias(f"_c{s}"))
    pairs = pick(1).join(pick(2), "_on").where("_id1 <> _id2")
    pairs = pairs.where("u1 <> u2") if skip_identical else pairs
    return pairs.groupBy("u1", "u2").agg(
        F.avg(metric(F.col("_c1"), F.col("_c2"))).alias("value"), F.count("*").alias("pairs"),
        F.sum(F.size("_c1")).alias("size1"), F.sum(F.size("_c2")).alias("size2"),
    )


def agreement_by_user(grid: DataFrame) -> DataFrame:
    return grid.groupBy(F.col("u1").alias("user")).agg(
        F.avg("value").alias("mean"), (F.sum(F.col("value") * F.col("pairs")) / F.sum("pairs")).alias("weighted"), F.sum("pairs").alias("pairs")
    )


def agreement_summary(grid: DataFrame, digits: int = 6) -> DataFrame:
    """One row over the users: mean, weighted mean, min, max, and the value at place n // 2 + 1 (from 0; null for n <= 2)."""
    users = agreement_by_user(grid).withColumn("mean", F.round("mean", digits))
    ordered = F.sort_array(F.collect_list("mean"))  # one value for each annotator
    return users.agg(
        F.avg("mean").alias("mean"), (F.sum(F.col("mean") * F.col("pairs")) / F.sum("pairs")).alias("weighted"), F.min("mean").alias("min"),
        F.max("mean").alias("max"), F.get(ordered, F.floor(F.count("*") / 2).cast("int") + 1).alias("pivot"),
    )


def suspicious_report(df: DataFrame, level: int = 10, by: str = "user") -> DataFrame:
    bad = F.size("appropriate") + F.size("inappropriate") >= level
    return df.groupBy(by).agg(F.count("*").alias("items"), F.count_if(bad).alias("suspicious"), F.avg(bad.cast("double")).alias("share"))


def time_reward(df: DataFrame, by: str = "user", strict: bool = False) -> DataFrame:
    """Minutes with an annotation, counted from a second before the first; strict: a last minute just begun is left out."""
    bounds = df.groupBy(by).agg((F.min("time") - 1).alias("_start"), F.max("time").alias("_end"))
    rows = df.join(bounds, by).withColumn("_bin", F.floor((F.col("time") - F.col("_start")) / 60))
    if strict:
        span = F.col("_end") - F.col("_start")
        bins = F.floor((span + 59 - F.lit(1)) / 60)  # bins that begin 60 s apart and end before the bound
        rows = rows.withColumn("_bin", F.when(F.col("_bin") < F.greatest(bins, F.lit(0)), F.col("_bin")))
    return rows.groupBy(by).agg(F.count_distinct("_bin").cast("double").alias("time_reward"))


#: Weights of the first annotated images.
POSITION_WEIGHTS = (1.0, 0.5, 0.5, 0.25, 0.25, 0.25, 0.25)


def item_reward(df: DataFrame, ca: Column, ci: Column) -> Column:
    """Weights of the first seven annotated images times the coefficient of their set (appropriate first)."""
    weights = F.array(*[F.lit(w) for w in POSITION_WEIGHTS])
    n = F.size("appropriate")
    return F.aggregate(
        F.transform(F.slice("combined", 1, len(POSITION_WEIGHTS)), lambda _, i: weights[i] * F.when(i < n, ca).otherwise(ci)), F.lit(0.0), lambda s, x: s + x
    )


def rewards(df: DataFrame, agree_a: DataFrame, agree_i: DataFrame, strict: bool = False) -> DataFrame:
    """time_reward, item_reward and total of each user; a user's coefficients are its agreements over the pivots."""
    def coefficient(grid: DataFrame, name: str) -> DataFrame:
        pivot = agreement_summary(grid).select(F.col("pivot").alias("_pivot"))
        users = agreement_by_user(grid).select("user", F.round("mean", 6).alias("_mean"))
        return users.join(F.broadcast(pivot)).select("user", (F.col("_mean") / F.col("_pivot")).alias(name))  # one row

    rows = combined(df).join(coefficient(agree_a, "_ca"), "user", "left").join(coefficient(agree_i, "_ci"), "user", "left")
    items = rows.groupBy("user").agg(F.sum(item_reward(rows, F.coalesce("_ca", F.lit(0.0)), F.coalesce("_ci", F.lit(0.0)))).alias("item_reward"))
    return items.join(time_reward(df, strict=strict), "user").withColumn("total", F.col("item_reward") + F.col("time_reward"))


def reward_totals(rewards: DataFrame) -> DataFrame:
    """One row: number of users and the sums of their rewards."""
    return rewards.agg(F.count("*").alias("users"), *[F.sum(c).alias(c) for c in ("time_reward", "item_reward", "total")])


def original_recall(df: DataFrame, originals: DataFrame, column: str = "appropriate", by: str = "user", guard: float = 0.00001) -> DataFrame:
    """originals (text, original): per user recall, precision and F of the original image; `guard` starts each count."""
    rows = df.join(originals, "text").where(F.array_contains("images", F.col("original")))
    hit = F.array_contains(column, F.col("original")).cast("double")
    out = rows.groupBy(by).agg((guard + F.sum(hit)).alias("_hits"), (guard + F.count("*")).alias("_rows"), (guard + F.sum(F.size(column))).alias("_images"), F.count("*").alias("n"))
    out = out.select(by, "n", (F.col("_hits") / F.col("_rows")).alias("recall"), (F.col("_hits") / F.col("_images")).alias("precision"))
    return out.withColumn("f", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def recall_means(by_user: DataFrame) -> DataFrame:
    """One row: means of what `original_recall` gives, weighted by the users' numbers of rows."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return by_user.agg(F.sum("n").alias("n"), mean("recall"), mean("precision"), mean("f"))


def overlapping(df: DataFrame, column: str, by: str = "text") -> DataFrame:
    """Images that all rows (two at least) of a text have in `column`, else an empty array."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    each = df.select(by, "id", F.explode(F.array_distinct(column)).alias("image")).groupBy(by, "image").agg(F.count_distinct("id").alias("_c"))
    shared = each.join(sizes, by).where("_c = _n AND _n >= 2").groupBy(by).agg(F.sort_array(F.collect_list("image")).alias("shared"))
    return sizes.join(shared, by, "left").select(by, F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def export_links(df: DataFrame, column: str = "appropriate") -> DataFrame:
    return df.select("text", F.explode(column).alias("image")).where("image <> ''").distinct()


def duplicate_texts(df: DataFrame) -> DataFrame:
    """text, id and n, the text's number of rows, of all rows whose text has several."""
    several = df.groupBy("text").agg(F.count("*").alias("n")).where("n > 1")
    return df.select("text", "id").join(several, "text")


def timeframe(df: DataFrame) -> DataFrame:
    t = df.agg(F.min("time").alias("first"), F.max("time").alias("last"))
    return t.withColumns({f"{c}_text": F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


def column_over_time(df: DataFrame, column: str, by: str = "user") -> DataFrame:
    """by, time, id and value; readers that need an order sort by these."""
    return df.select(by, "time", "id", F.col(column).alias("value"))


def last_by(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("time"), F.desc("id"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
