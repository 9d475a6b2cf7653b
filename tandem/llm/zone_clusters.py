"""Centroid clustering over zone maps of vectors in the order of a space-filling curve.

Vectors become integers, floor(scale * x).  One pass finds the axes that vary most; on up to `axes` of them each
vector falls into one of 2**bits cells an axis, and its place on the Hilbert curve through these cells is its key.  The
vectors are range-partitioned by that key (a second, scattered key splits one that many vectors share) and cut into
blocks of neighbours, one row each: its vectors and its box, the least and greatest value of each component.  The table
of blocks is written once.

Each round reads the blocks.  On a box, the difference of a point's squared distances to two centroids is linear in the
point, so its greatest value over the box is known from the corners.  A centroid that is farther than a reference (the
one nearest to the box's middle, or to either of its ends) at every point of the box can be no vector's nearest; the
others are the block's candidates, and only these are compared with its vectors, exactly and all at once.  A block with
one candidate needs no comparison.  Each task returns the sums of its vectors by centroid, at most k rows.

Vectors that are null, don't have `dims` components, or hold null or non-finite ones take no part.  Repeated rows and
ids count as often as they occur.  Rows of a null id take part, and are the last to be seeds; with fewer than k rows
there are fewer centroids; an empty table gives no rows.  Integers beyond +-2**27 are held to that.  The sums over a
cluster and over all are null beyond 64 bits.  Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm._common import written
from tandem.llm._vectors import digest, integers, nearest, rows_of


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of (rows, axes) cells on the Hilbert curve, as 64-bit integers; axes * bits is 64 at most.

    The cells are turned into the transposed index (Skilling, 2004), whose bits are then interleaved.
    """
    x = cells.T.astype(np.uint64).copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(len(x)):
            hit = (x[i] >> np.uint64(b)) & one == 1
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << one | (axis >> np.uint64(b)) & one
    return (key ^ np.uint64(1 << 63)).view(np.int64)  # the same order, signed


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that some point of the box may have as its nearest (or tied), ascending."""
    stays = np.ones(len(centroids), bool)
    lo, hi, c = (a.astype(np.int64) for a in (low, high, centroids))
    norms = (c * c).sum(1)
    for point in ((lo + hi) // 2, lo, hi):
        a = int((norms - 2 * (c @ point)).argmin())
        way = c - c[a]
        # d(x, a) - d(x, b) = |a|^2 - |b|^2 + 2 x (b - a), greatest at the corner where each term is
        most = norms[a] - norms + 2 * np.where(way > 0, way * hi, way * lo).sum(1)
        stays &= most >= 0
    return np.flatnonzero(stays)


def zone_blocks(vectors: DataFrame, dims: int, axes: int = 16, bits: int = 4, block_rows: int = 256, part_rows: int = 65_536) -> DataFrame:
    """Written table of blocks of rows (id, v): ids, v, low and high (arrays)."""
    spark = vectors.sparkSession
    x = lambda j: F.col("v")[j].cast("double")
    row = vectors.agg(F.count("*").alias("n"), *[F.avg(x(j)).alias(f"m{j}") for j in range(dims)], *[F.coalesce(F.stddev_pop(x(j)), F.lit(0.0)).alias(f"s{j}") for j in range(dims)]).first()
    mean, spread = (np.array([row[f"{c}{j}"] or 0.0 for j in range(dims)]) for c in "ms")
    use = np.argsort(-spread, kind="stable")[: min(axes, dims)]
    start, step = (mean - 2 * spread)[use], np.maximum(4 * spread[use], 1e-9) / (1 << bits)

    def key(frames):
        for b in frames:
            if b.num_rows:
                v = rows_of(b.column(1), dims)[:, use]
                cells = np.clip((v - start) // step, 0, (1 << bits) - 1)
                scatter = np.arange(len(v), dtype=np.int64) * 0x9E3779B1 % (1 << 31)
                yield pa.RecordBatch.from_arrays([pa.array(hilbert_keys(cells, bits)), pa.array(scatter), b.column(0), b.column(1)], names=["key", "scatter", "id", "v"])

    kind = vectors.schema["id"].dataType.simpleString()
    keyed = vectors.select("id", "v").mapInArrow(key, f"key long, scatter long, id {kind}, v array<int>")
    parts = max(spark.sparkContext.defaultParallelism, -(-row["n"] // part_rows))
    ordered = keyed.repartitionByRange(parts, "key", "scatter").sortWithinPartitions("key", "scatter").select("id", "v")

    def block(frames):
        for b in frames:
            for at in range(0, b.num_rows, block_rows):
                own = b.slice(at, block_rows)
                v = rows_of(own.column(1), dims).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(0))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([a]) for a in (v.ravel(), v.min(0), v.max(0)))], names=["ids", "v", "low", "high"])

    return written(ordered.mapInArrow(block, f"ids array<{kind}>, v array<int>, low array<int>, high array<int>"), "blocks")


def _each(frames, centroids: np.ndarray):
    """For each block: ids, vectors, numbers of the nearest centroids, squared distances and the number of candidates."""
    dims = centroids.shape[1]
    for b in frames:
        for i in range(b.num_rows):
            ids, v, low, high = (b.column(b.schema.get_field_index(c))[i].values for c in ("ids", "v", "low", "high"))
            v = v.to_numpy().reshape(-1, dims).astype(np.int64)
            near = candidates(low.to_numpy(), high.to_numpy(), centroids)
            which, dist = nearest(v, centroids[near])
            yield ids, v, near[which], dist, len(near)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    k, dims = centroids.shape

    def add(frames):
        n, sums, compared = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, v, which, _, near in _each(frames, centroids):
            order = np.argsort(which, kind="stable")
            used, at = np.unique(which[order], return_index=True)
            sums[used] += np.add.reduceat(v[order], at, axis=0)
            n += np.bincount(which, minlength=k)
            compared[used[0]] += near * len(v)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(compared[has]), pa.array(list(sums[has]), pa.list_(pa.int64()))], names=["cluster", "n", "compared", "sums"])

    return blocks.mapInArrow(add, "cluster int, n long, compared long, sums array<long>")


def fit(blocks: DataFrame, centroids: np.ndarray, rounds: int, shares: list[float] | None = None) -> np.ndarray:
    """Centroids after the rounds; `shares` gets each round's share of the comparisons that the boxes left to make."""
    k, dims = centroids.shape
    for _ in range(rounds):
        found = _sums(blocks, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("compared").alias("c"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dims)]).collect()  # k rows at most
        new = centroids.copy()
        for r in found:
            new[r["cluster"]] = np.array([r[f"s{j}"] for j in range(dims)], np.int64) // r["n"]
        if shares is not None:
            shares.append(sum(r["c"] for r in found) / (k * max(1, sum(r["n"] for r in found))))
        if (new == centroids).all():
            break  # every later round would be the same
        centroids = new
    return centroids


def cluster(
    vectors: DataFrame, k: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding", shares: list[float] | None = None
) -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector.

    The first centroids are the k vectors with the smallest sha256 of `seed` and their id, ties by id and vector.
    """
    spark = vectors.sparkSession
    kept = integers(vectors, scale, vec_col, F.col(id_col).alias("id")).where(F.size("v") == dims)
    mark = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    seeds = kept.orderBy(mark.asc_nulls_last(), F.col("id").asc_nulls_last(), "v").limit(k).collect()
    kind = kept.schema["id"].dataType.simpleString()
    if not seeds:
        none = spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return none.withColumnRenamed("id", id_col)
    blocks = zone_blocks(kept, dims)
    centroids = fit(blocks, np.array([r["v"] for r in seeds], np.int64), rounds, shares)

    def assign(frames):
        for ids, _, which, dist, _ in _each(frames, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(dist)], names=["id", "cluster", "distance"])

    assigned = written(blocks.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()  # k rows at most
    whole = sum(r["total"] for r in sums) if all(r["total"] is not None for r in sums) else None
    whole = whole if whole is None or whole < 1 << 63 else None
    rows = [(r["cluster"], r["total"], whole, digest(centroids[r["cluster"]])) for r in sums]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(about), "cluster")  # k rows at most
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
