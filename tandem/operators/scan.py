"""Scans over a whole ordered sequence, without a key to split it by: range parts, and a carry table between them.

The rows are cut into range parts of the order and written once.  Each part is scanned by itself; one row for each part
says how it begins and ends and what it adds; running sums over these rows give what each part starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators._shared import written


def range_parts(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Written table of the rows with `_part`, ascending in the order; it has to be total, else equal keys share a part."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "range-parts")


def _before(column: str, part):
    return F.coalesce(F.sum(column).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def runs_of_all(rows: DataFrame, order: list[str], doc: str, parts: int | None = None) -> DataFrame:
    """Add `run`, the number of the run of consecutive rows with one `doc` in the whole sequence."""
    cut = range_parts(rows, order, parts)
    own = Window.partitionBy("_part").orderBy(*order)
    change = (~F.col(doc).eqNullSafe(F.lag(doc).over(own)) & (F.row_number().over(own) > 1)).cast("long")
    marked = cut.withColumn("_change", change)
    local = marked.withColumn("_local", F.sum("_change").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    pair = F.struct(place.alias("at"), F.col(doc).alias("doc"))  # a doc may be null
    borders = marked.groupBy("_part").agg(F.sum("_change").alias("changes"), F.min(pair)["doc"].alias("first"), F.max(pair)["doc"].alias("last"))
    part = Window.orderBy("_part")  # one row for each part
    opens = (~F.col("first").eqNullSafe(F.lag("last").over(part)) & (F.row_number().over(part) > 1)).cast("long")
    borders = borders.withColumn("opens", opens)
    starts = borders.select("_part", (_before("changes", part) + F.sum("opens").over(part.rowsBetween(Window.unboundedPreceding, 0))).alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn("run", F.col("_local") + F.col("_start")).drop("_part", "_change", "_local", "_start")


def shrunk_gap(difference):
    """At most 1; 0 where there is no value before."""
    return F.when(difference.isNotNull(), F.least(difference, F.lit(1.0))).otherwise(0.0)


def squish_all(values: DataFrame, value: str = "value", parts: int | None = None) -> DataFrame:
    """All values in order with every gap over 1 shrunk to 1: `squished`."""
    cut = range_parts(values, [value], parts)
    own = Window.partitionBy("_part").orderBy(value)
    gap = shrunk_gap(F.col(value) - F.lag(value).over(own))
    marked = cut.withColumn("_gap", gap)
    local = marked.withColumn("_local", F.sum("_gap").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    borders = marked.groupBy("_part").agg(F.sum("_gap").alias("adds"), F.min(value).alias("first"), F.max(value).alias("last"))
    part = Window.orderBy("_part")  # one row for each part
    opens = shrunk_gap(F.col("first") - F.lag("last").over(part))
    low = F.min("first").over(Window.partitionBy(F.lit(0)))
    borders = borders.withColumn("opens", opens)
    starts = borders.select("_part", (low + _before("adds", part) + F.sum("opens").over(part.rowsBetween(Window.unboundedPreceding, 0))).alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn("squished", F.col("_local") + F.col("_start")).drop("_part", "_gap", "_local", "_start")
