"""Exact top-k by cosine over an inverted index whose postings carry upper bounds; all items have unit norm.

A query's features stand in order of their postings' length.  From each place on, the score that is still to come is at
most the sum of |query weight| times the feature's largest weight, and at most the norm of the query's rest, as an
item's norm is one.  A few exact scores give each query a lower bound of its k-th best: for every feature the k
heaviest postings, of these the 2k best so far, scored in full.  Postings are read only up to the place from which the
rest can't reach that bound.  Items met there whose score so far plus the bound of the rest reaches it are completed
from their own cells.  Nothing is lost, ties included: the bounds keep a margin of one unit of the rounded score.

Long postings are dealt by (feature, part), so that no task gets a feature of every item whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators import sparse_blocks
from tandem.operators._shared import written

#: Features with parts that are broadcast at most; there are fewer than cells / part_rows of them.
HOT_FEATURES = 10_000
#: Up to so many joined rows for each cell of the database the plain join is made.
PLAIN = 4
#: The bounds are used if they leave at most this share of the joined rows.
MOST = 0.6
#: With more joined rows than MANY, and so many of them for a pair of items on average, groups of items are multiplied.
MANY, DENSE = 5_000_000, 1


def query_bounds(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, feature, q, n (postings) and bound: the most that this feature and the ones behind it can add."""
    met = queries.select(F.col("item_id").alias("query_id"), "feature", F.col("value").alias("q")).join(postings, "feature")
    rest = Window.partitionBy("query_id").orderBy("n", "feature").rowsBetween(0, Window.unboundedFollowing)
    weights = F.sum(F.abs("q") * F.col("w")).over(rest)
    norm = F.sqrt(F.sum(F.col("q") * F.col("q")).over(rest))
    return met.select("query_id", "feature", "q", "n", F.least(weights, norm).alias("bound"))


def _dealt(left: DataFrame, right: DataFrame, hot: DataFrame | None, item: str) -> DataFrame:
    """Join on the feature; `right`'s rows of a hot feature are dealt to parts by their item, `left`'s go to each part."""
    if hot is None:
        return left.join(right, "feature")
    parts = F.coalesce("parts", F.lit(1))
    a = left.join(hot, "feature", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("parts")
    b = right.join(hot, "feature", "left").withColumn("_part", F.pmod(F.xxhash64(item), parts).cast("int")).drop("parts")
    return a.join(b, ["feature", "_part"]).drop("_part")


def _scores(pairs: DataFrame, cells: DataFrame, database: DataFrame) -> DataFrame:
    """query_id, target_id and the sum of products over the given cells (query_id, feature, q) of the queries."""
    found = pairs.join(database, "target_id").join(cells.select("query_id", "feature", "q"), ["query_id", "feature"])
    return found.groupBy("query_id", "target_id").agg(F.sum(F.col("q") * F.col("d")).alias("sim"))


def _hot(postings: DataFrame, part_rows: int) -> DataFrame | None:
    """feature and parts of the long postings, HOT_FEATURES at most; None if there are none."""
    size, longest = postings.agg(F.sum("n"), F.max("n")).first()
    per_part = max(part_rows, -(-(size or 0) // HOT_FEATURES))
    if (longest or 0) <= per_part:
        return None
    return F.broadcast(postings.where(F.col("n") > per_part).select("feature", F.ceil(F.col("n") / per_part).alias("parts")))


def indexed(database: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the database as target_id, feature, d; for each feature n (postings) and w (largest weight)."""
    d = written(database.select(F.col("item_id").alias("target_id"), "feature", F.col("value").alias("d")), "index")
    return d, written(d.groupBy("feature").agg(F.count("*").alias("n"), F.max(F.abs("d")).alias("w")), "postings")


def needed_cells(queries: DataFrame, d: DataFrame, postings: DataFrame, k: int, digits: int) -> DataFrame:
    """Written table: the queries' cells with `needed` and `goal` (what a score has to reach; null: anything)."""
    cells = written(query_bounds(queries, postings), "query-bounds")
    heaviest = Window.partitionBy("feature").orderBy(F.desc(F.abs("d")), "target_id")
    champions = d.join(cells.select("feature").distinct(), "feature", "left_semi").withColumn("_r", F.row_number().over(heaviest)).where(F.col("_r") <= k).drop("_r")
    so_far = cells.join(champions, "feature").groupBy("query_id", "target_id").agg(F.sum(F.col("q") * F.col("d")).alias("s"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"), "target_id")
    seeds = so_far.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= 2 * k).select("query_id", "target_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim")))
    goals = _scores(seeds, cells, d).withColumn("_r", place).where(F.col("_r") == k).select("query_id", (F.col("sim") - 10.0**-digits).alias("goal"))
    cells = cells.join(goals, "query_id", "left").withColumn("needed", F.col("goal").isNull() | (F.col("bound") >= F.col("goal")))
    return written(cells, "query-cells")


def _items(df: DataFrame, key: str) -> int:
    return df.agg(F.approx_count_distinct(key)).first()[0] or 0


def topk(queries: DataFrame, database: DataFrame, k: int, digits: int, part_rows: int = 10_000) -> DataFrame:
    """query_id, target_id and sim of a superset of each query's k best, with exact scores.

    Where pairs share several features on average, no bound keeps most of the joined rows away: groups of items are
    multiplied then, without a row for each shared cell.  Else all postings are joined at once where that makes few rows for each cell of the database (the bounds would cost more
    than they save), and where the bounds leave most of the rows.
    """
    d, postings = indexed(database)
    wanted = queries.groupBy("feature").agg(F.count("*").alias("q"))
    joined, size = postings.join(wanted, "feature", "left").agg(F.sum(F.col("n") * F.col("q")), F.sum("n")).first()
    if (joined or 0) > max(MANY, DENSE * _items(queries, "item_id") * _items(d, "target_id")):
        return sparse_blocks.products(sparse_blocks.bags(queries, "item_id", "feature", F.col("value")), sparse_blocks.bags(d, "target_id", "feature", F.col("d")), k, digits)
    hot = _hot(postings, part_rows)
    cells = needed_cells(queries, d, postings, k, digits) if (joined or 0) > PLAIN * (size or 0) else None
    if cells is None or cells.where("needed").agg(F.sum("n")).first()[0] > MOST * joined:
        q = queries.select(F.col("item_id").alias("query_id"), "feature", F.col("value").alias("q"))
        return _dealt(q, d, hot, "target_id").groupBy("query_id", "target_id").agg(F.sum(F.col("q") * F.col("d")).alias("sim"))
    rest = F.max(F.when(~F.col("needed"), F.col("bound"))).over(Window.partitionBy("query_id"))
    cells = cells.withColumn("rest", F.coalesce(rest, F.lit(0.0)))
    met = _dealt(cells.where("needed").select("query_id", "feature", "q", "goal", "rest"), d, hot, "target_id")
    sums = met.groupBy("query_id", "target_id", "goal", "rest").agg(F.sum(F.col("q") * F.col("d")).alias("sim"))
    reached = sums.where(F.col("goal").isNull() | (F.col("sim") + F.col("rest") >= F.col("goal")))
    reached = written(reached.select("query_id", "target_id", "sim", (F.col("rest") > 0).alias("open")), "reached")
    behind = _scores(reached.where("open").select("query_id", "target_id"), cells.where(~F.col("needed")), d)
    whole = reached.select("query_id", "target_id", "sim").unionByName(behind)
    return whole.groupBy("query_id", "target_id").agg(F.sum("sim").alias("sim"))


def all_pairs(queries: DataFrame, database: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """query_id, target_id and sim of all pairs that share a feature."""
    d, postings = indexed(database)
    q = queries.select(F.col("item_id").alias("query_id"), "feature", F.col("value").alias("q"))
    return _dealt(q, d, _hot(postings, part_rows), "target_id").groupBy("query_id", "target_id").agg(F.sum(F.col("q") * F.col("d")).alias("sim"))
