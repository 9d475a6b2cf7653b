"""Blocks of near vectors, and the pairs of blocks that can hold a similar pair: pruning by angles to pivots.

Pivots are a bounded number of vectors, chosen by hash.  The angle between two vectors is at least the difference of
their angles to any pivot.  Vectors are put in order of their nearest pivot and their angle to it, range-partitioned in
that order, and cut into blocks; a block's row has its vectors and its least and greatest angle to each pivot.  Two
blocks meet only if no pivot puts them further apart than the angle of the least similarity asked for.

Which blocks those are is found without comparing every two: a block is listed in the bins, one wanted angle wide, that
its angles to the widest-spread pivot touch, and blocks are paired within a bin and with the next one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators import meet
from tandem.operators._shared import written
from tandem.operators.random import hash_order

#: Angles are compared with this margin, far over the rounding of arccos near 1.
MARGIN = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def angle_blocks(items: DataFrame, pivots: int = 32, block_rows: int = 1024) -> DataFrame:
    """Written table of blocks of (item_id, vec), no vector being all zeros: block, ids, vec, low and high."""
    spark = items.sparkSession
    chosen = [r["vec"] for r in items.orderBy(hash_order("item_id"), "item_id").limit(pivots).collect()]
    p = unit(np.array(chosen, float)) if chosen else np.zeros((1, 1))
    n = items.count()

    def place(frames):
        for b in frames:
            if b.num_rows:
                angles = np.arccos(np.clip(unit(_matrix(b.column(1))) @ p.T, -1, 1))
                near = angles.argmin(1)
                own = angles[np.arange(len(near)), near]
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(own), b.column(0), b.column(1)], names=["pivot", "angle", "item_id", "vec"])

    kept = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast("array<double>").alias("vec"))
    placed = kept.mapInArrow(place, "pivot int, angle double, item_id long, vec array<double>")
    parts = max(1, -(-n // (16 * block_rows)))
    order = ("pivot", "angle", "item_id")
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("pivot", "item_id", "vec")

    def cut(frames):
        for b in frames:
            if not b.num_rows:
                continue
            pivot = b.column(0).to_numpy()
            ends = np.flatnonzero(np.r_[pivot[1:] != pivot[:-1], True]) + 1
            start = 0
            for end in ends.tolist():
                for at in range(start, end, block_rows):
                    own = b.slice(at, min(end, at + block_rows) - at)
                    x = _matrix(own.column(2))
                    angles = np.arccos(np.clip(unit(x) @ p.T, -1, 1))
                    lists = [pa.array([a]) for a in (own.column(1).to_numpy(), x.ravel(), angles.min(0), angles.max(0))]
                    yield pa.RecordBatch.from_arrays(lists, names=["ids", "vec", "low", "high"])
                start = end

    blocks = ordered.mapInArrow(cut, "ids array<long>, vec array<double>, low array<double>, high array<double>")
    return written(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "angle-blocks")


def near_blocks(blocks: DataFrame, least: float) -> DataFrame:
    """a and b (a <= b) of the blocks that can hold a pair of cosine `least` or more."""
    limit = math.acos(max(-1.0, min(1.0, least))) + MARGIN
    zones = blocks.select("block", "low", "high")
    first = zones.select(F.posexplode("low").alias("pivot", "x")).groupBy("pivot").agg(F.stddev_pop("x").alias("s")).orderBy(F.desc("s"), "pivot").first()
    widest = first["pivot"] if first else 0
    bin_ = lambda side: F.floor(F.col(side)[widest] / limit).cast("long")
    a = zones.select(F.col("block").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.explode(F.sequence(bin_("low") - 1, bin_("high") + 1)).alias("bin"))
    b = zones.select(F.col("block").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.explode(F.sequence(bin_("low"), bin_("high"))).alias("bin"))
    apart = F.exists(F.arrays_zip("a_low", "a_high", "b_low", "b_high"), lambda z: (z["a_low"] - z["b_high"] > limit) | (z["b_low"] - z["a_high"] > limit))
    return a.join(b, "bin").where((F.col("a") <= F.col("b")) & ~apart).select("a", "b").distinct()


def close(x: np.ndarray, y: np.ndarray, least: float, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places r, c and rounded cosines of the rows of x and y (of unit norm) that reach `least`.

    A product in single precision, whose error is bounded by the number of components, leaves candidates; only these
    are computed in double precision.
    """
    margin = (x.shape[1] + 4) * 1.2e-7 + 10.0**-digits
    at = np.flatnonzero(x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(least - margin))
    r, c = at // len(y), at % len(y)
    sims = np.einsum("ij,ij->i", x[r], y[c]) if len(r) * x.shape[1] <= 1 << 22 else (x @ y.T)[r, c]
    sims = np.round(sims, digits) + 0.0
    kept = sims >= least
    return r[kept], c[kept], sims[kept]


def pairs_of_blocks(blocks: DataFrame, met: DataFrame, least: float, digits: int, groups: int | None = None) -> DataFrame:
    """query_id < target_id and sim (rounded) of the pairs of cosine `least` or more in the blocks that meet.

    Blocks are put in groups, in their order, and each pair of groups that have blocks to meet is a task: a block is
    sent once for each group that it meets, not for each block.
    """
    sizes = blocks.agg(F.count("*").alias("n"), F.sum(F.size("vec").cast("long") * 8).alias("bytes")).first()
    n = groups or max(-(-(sizes["bytes"] or 0) // (2 * meet.GROUP_BYTES)), math.isqrt(2 * meet.tasks(blocks.sparkSession)) + 1)
    n = max(1, min(n, sizes["n"]))
    place = F.row_number().over(Window.orderBy("block")) - 1  # a row for each block
    group = blocks.select("block").withColumn("group", F.floor(place * n / max(1, sizes["n"])).cast("long"))
    of = lambda side: group.select(F.col("block").alias(side), F.col("group").alias(f"{side}_group"))
    i, j = F.col("a_group"), F.col("b_group")
    pair = (F.floor(i * (2 * n - i + 1) / 2) + j - i).cast("int")
    paired = written(met.join(of("a"), "a").join(of("b"), "b").select("a", "b", pair.alias("pair")), "block-pairs")
    own = blocks.select("block", "ids", "vec")
    left = paired.groupBy("pair", F.col("a").alias("block")).agg(F.collect_list("b").alias("partners")).join(own, "block").withColumn("side", F.lit(0))
    right = paired.select("pair", F.col("b").alias("block")).distinct().join(own, "block").withColumn("side", F.lit(1))

    def rows(b):
        for k, x in enumerate(b.column("vec")):
            ids = b.column("ids")[k].values.to_numpy()
            yield b.column("block")[k].as_py(), ids, unit(x.values.to_numpy().reshape(len(ids), -1)), b.column("partners")[k].as_py()

    def hold(batches):
        return [(a, ids, x, set(partners)) for b in batches for a, ids, x, partners in rows(b)]

    def score(held, batch):
        for b, yi, y, _ in rows(batch):
            for a, xi, x, partners in held:
                if b in partners:
                    r, c, sims = close(x, y, least, digits)
                    if a == b:
                        r, c, sims = (v[r < c] for v in (r, c, sims))
                    yield pa.RecordBatch.from_pydict({"query_id": np.minimum(xi[r], yi[c]), "target_id": np.maximum(xi[r], yi[c]), "sim": sims})

    both = meet.together(left, right, n * (n + 1) // 2, "block").select("pair", "side", "block", "ids", "vec", "partners")
    return both.mapInArrow(lambda frames: meet.against(frames, hold, score), "query_id long, target_id long, sim double")
