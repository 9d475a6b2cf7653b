"""Every row of one table against every row of another: pairs of groups, each pair in one task.

A row goes to one group of its side, by its hash, and is sent to each pair that its group is part of.  A task gets the
left group of its pair first and holds it; the right group is read past it, batch by batch.  So a table is sent as
often as the other side has groups, and a task's memory is that of one left group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a left group, which a task holds.
GROUP_BYTES = 32 << 20


def tasks(spark) -> int:
    """Pairs that keep every core busy."""
    return 2 * spark.sparkContext.defaultParallelism


def group_of(n: int, key: str = "item_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def dealt(left: DataFrame, right: DataFrame, n_left: int, n_right: int, order: str = "item_id", key: str = "item_id") -> DataFrame:
    """Rows of both sides with `pair` and `side` (0 left, 1 right), sorted by pair, side and `order`; a pair's rows are in one partition."""
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_own", group_of(n_left, key)).withColumn("_other", to(n_right)).withColumn("pair", F.col("_own") * n_right + F.col("_other")).withColumn("side", F.lit(0))
    b = right.withColumn("_own", group_of(n_right, key)).withColumn("_other", to(n_left)).withColumn("pair", F.col("_other") * n_right + F.col("_own")).withColumn("side", F.lit(1))
    return together(a.drop("_own", "_other"), b.drop("_own", "_other"), n_left * n_right, order)


def together(left: DataFrame, right: DataFrame, pairs: int, order: str) -> DataFrame:
    """Rows with `pair` (from 0) and `side`, each pair in a partition of its own, the left rows first."""
    rows = left.unionByName(right, allowMissingColumns=True)
    return rows.repartitionById(pairs, F.col("pair").cast("int")).sortWithinPartitions("pair", "side", order)


def runs(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """pair, side and rows of each run of equal pair and side in the batches."""
    for b in frames:
        if b.num_rows:
            key = b.column("pair").to_numpy() * 2 + b.column("side").to_numpy()
            ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
            for start, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                yield int(key[start]) // 2, int(key[start]) % 2, b.slice(start, end - start)


def against(frames: Iterator[pa.RecordBatch], hold: Callable, meet: Callable, end: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """For each pair hold(left batches) once, then what meet(held, right batch) yields for each batch, and end(held)."""
    now, left, held = None, [], None
    for pair, side, rows in runs(frames):
        if pair != now:
            if held is not None and end:
                yield from end(held)
            now, left, held = pair, [], None
        if not side:
            left.append(rows)
        elif left:
            if held is None:
                held = hold(left)
            yield from meet(held, rows)
    if held is not None and end:
        yield from end(held)
