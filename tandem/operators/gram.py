"""X'X of a sparse matrix by tiles: each task adds the products of its items as dense tiles, which are then summed.

Features are numbered; the numbers are cut into blocks of `tile`.  A task turns its items into dense rows, some
hundreds at a time, and adds X_i' X_j to the tile of each pair of blocks i <= j.  It holds at most `held` bytes of tiles
and sends what it has when there are more.  Tiles are summed in two steps, first within groups of tasks, so that no
task gets a tile from every other.  A last column of ones gives the features' sums.  No item's pairs are spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators._shared import written

_TILE = "i int, j int, part int, tile array<double>"


def _row(i: int, j: int, part: int, tile: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (i, j, part)] + [pa.array([tile.ravel()])], names=["i", "j", "part", "tile"])


def _products(width: int, tile: int, held: int, rows: int = 512):
    def add(frames):
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for b in frames:
            part = b.column(0)
            cells, values = b.column(1), b.column(2)
            for at in range(0, b.num_rows, rows):
                own, weights = cells.slice(at, rows), values.slice(at, rows)
                sizes = np.diff(own.offsets.to_numpy())
                x = np.zeros((len(own), width))
                x[np.repeat(np.arange(len(own)), sizes), own.flatten().to_numpy()] = weights.flatten().to_numpy()
                x[:, -1] = 1
                used = np.unique(np.flatnonzero(x.any(axis=0)) // tile).tolist()
                for k, i in enumerate(used):
                    left = x[:, i * tile : (i + 1) * tile].T
                    for j in used[k:]:
                        got = left @ x[:, j * tile : (j + 1) * tile]
                        if (i, j) in tiles:
                            tiles[i, j] += got
                        else:
                            tiles[i, j] = got
                if len(tiles) * tile * tile * 8 > held:
                    for (i, j), t in tiles.items():
                        yield _row(i, j, part[0].as_py(), t)
                    tiles = {}
            last = part[0].as_py() if b.num_rows else 0
        for (i, j), t in tiles.items():
            yield _row(i, j, last, t)

    return add


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, total = None, None
    for b in batches:
        for n in range(b.num_rows):
            key = key or tuple(b.column(c)[n].as_py() for c in range(3))
            got = b.column(3)[n].values.to_numpy()
            total = got.copy() if total is None else total + got
    if key:
        yield _row(*key, total)


def gram(cells: DataFrame, features: DataFrame, tile: int = 128, held: int = 64 << 20, groups: int = 16) -> tuple[DataFrame, DataFrame]:
    """pairs (i < j, s: the sum of products) and moments (feature, s, ss) of the selected features; features are distinct and bounded, as their pairs are the result."""
    numbers = features.select("feature").distinct().sort("feature").collect()
    spark, d = cells.sparkSession, len(numbers)
    index = written(spark.createDataFrame([(r["feature"], n) for n, r in enumerate(numbers)], f"feature {features.schema['feature'].dataType.simpleString()}, _at int"), "features")
    own = cells.join(F.broadcast(index) if d <= 100_000 else index, "feature").groupBy("item_id", "_at").agg(F.sum("value").alias("value"))
    listed = own.groupBy("item_id").agg(F.collect_list(F.struct("_at", F.col("value").cast("double").alias("value"))).alias("c"))  # d cells at most
    sent = listed.select((F.spark_partition_id() % groups).alias("part"), F.col("c._at").alias("at"), F.col("c.value").alias("value"))
    blocks = -(-(d + 1) // tile)
    high = lambda c: F.least(F.lit(tile), F.lit(d + 1) - F.col(c) * tile)
    grid = spark.range(blocks).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(blocks - 1))).alias("j"))
    zeros = grid.select("i", "j", F.lit(0).alias("part"), F.array_repeat(F.lit(0.0), (high("i") * high("j")).cast("int")).alias("tile"))  # tiles that no item has
    tiles = sent.mapInArrow(_products(d + 1, tile, held), _TILE).unionByName(zeros)
    tiles = tiles.groupBy("i", "j", "part").applyInArrow(_sum, _TILE).withColumn("part", F.lit(0)).groupBy("i", "j").applyInArrow(_sum, _TILE)
    cell = tiles.select((F.col("i") * tile).alias("i"), (F.col("j") * tile).alias("j"), high("j").alias("w"), F.posexplode("tile").alias("k", "s"))
    table = written(cell.select((F.col("i") + F.floor(F.col("k") / F.col("w"))).cast("int").alias("i"), (F.col("j") + F.col("k") % F.col("w")).alias("j"), "s").where("i <= j"), "gram")
    name = lambda at, as_: index.select(F.col("_at").alias(at), F.col("feature").alias(as_))
    small = F.broadcast if d <= 100_000 else (lambda df: df)
    pairs = table.where(f"i < j AND j < {d}").join(small(name("i", "_i")), "i").join(small(name("j", "_j")), "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "s")
    squares = table.where("i = j").select(F.col("i").alias("_at"), F.col("s").alias("ss"))
    sums = table.where(f"j = {d}").select(F.col("i").alias("_at"), "s")
    moments = index.join(squares, "_at", "left").join(sums, "_at", "left").select("feature", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("ss", F.lit(0.0)).alias("ss"))
    return pairs, moments
