"""Exact top-k search by inner product over a bit-sliced index.

Each component is turned into an integer, floor(scale * x).  Equal vectors are one row of the index, with their
k + 1 smallest ids, so a vector that a third of all rows hold is one row.  Rows are dealt into blocks; a block keeps,
for each component, the bits of its values as bitmaps over the block's rows (slices), the least significant `coarse`
slices left out.  A query's score is then a sum of slices shifted by the bits of its own components: the bitmaps of
one significance are added three at a time by carry-save steps (AND, XOR) until one remains, which gives the slices
of the sum.  The best rows are read off those slices from the most significant downward: rows above a prefix are in,
rows below are out, and the rest stay tied.  As left-out slices make the sum an underestimate by a known amount, every
row within that amount of the k-th is a boundary row; the exact scores of the boundary rows decide.

Queries and blocks meet by a join on block numbers, each query block going to each index block once.  Each pair
returns its k best; a window keeps the k best of all, ties to the smaller id.

Vectors that are null or hold null or non-finite components take no part; vectors of another length than a query's
are not its candidates.  Rows that repeat both id and vector count once, in queries as well; no row with a query's id
is its candidate.  An id with several vectors is one candidate, or one query, by its best score.  Scores are 64-bit
integers.  An empty table gives no rows.  Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm._common import written


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, v array<long>) of the vectors that take part."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    taken = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return taken.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def _slices(values: np.ndarray, low: np.ndarray, bits: int, coarse: int) -> np.ndarray:
    """Bitmaps of values - low: (components, bits - coarse, 64-bit words over the rows)."""
    n, dims = values.shape
    words = -(-n // 64)
    out = np.zeros((dims, bits - coarse, words * 8), np.uint8)
    above = (values - low).T.astype(np.uint64)
    for j in range(coarse, bits):
        packed = np.packbits((above >> np.uint64(j) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
        out[:, j - coarse, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _added(by_place: dict[int, list[np.ndarray]]) -> list[np.ndarray | None]:
    """Slices of the sum of bitmaps, each list holding stacks of bitmaps of one significance."""
    out, place = [], 0
    while any(p >= place for p in by_place):
        stacks = by_place.pop(place, [])
        stack = np.concatenate(stacks) if stacks else None
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                x = a ^ b
                carry = a & b | x & c
                stack = np.concatenate([x ^ c, stack[3 * n :]])
            else:
                carry, stack = (stack[0] & stack[1])[None], (stack[0] ^ stack[1])[None]
            by_place.setdefault(place + 1, []).append(carry)
        out.append(None if stack is None else stack[0])
        place += 1
    return out


def _ones(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def _candidates(sums: list[np.ndarray | None], present: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Bitmap of all rows whose sum is at least the k-th largest sum less `slack`."""
    tied, above, kth = present, np.zeros_like(present), 0
    for place in range(len(sums) - 1, -1, -1):  # the k-th largest sum, bit by bit
        s = sums[place]
        if s is None:
            continue
        both = above | tied & s
        if _ones(both) >= k:
            tied, kth = tied & s, kth | 1 << place
        else:
            above, tied = both, tied & ~s
    least = max(0, kth - slack)
    eq, gt = present, np.zeros_like(present)
    for place in range(max(len(sums), least.bit_length()) - 1, -1, -1):  # rows at or above `least`
        s = sums[place] if place < len(sums) and sums[place] is not None else np.zeros_like(present)
        if least >> place & 1:
            eq = eq & s
        else:
            gt, eq = gt | eq & s, eq & ~s
    return gt | eq


class Block:
    """Index of some distinct vectors."""

    def __init__(self, values: np.ndarray, coarse: int = 3):
        self.values = values
        self.low = values.min(axis=0)
        self.bits = max(1, int((values - self.low).max()).bit_length())
        self.coarse = min(coarse, self.bits - 1)
        self.slices = _slices(values, self.low, self.bits, self.coarse)
        rows = np.zeros(self.slices.shape[2] * 64, np.uint8)
        rows[: len(values)] = 1
        self.present = np.packbits(rows, bitorder="little").view(np.uint64)

    def top(self, query: np.ndarray, k: int, without: np.ndarray | tuple = ()) -> np.ndarray:
        """Of the rows not in `without` those that hold the k best scores, and perhaps others."""
        present = self.present
        if len(without):
            rows = np.unpackbits(present.view(np.uint8), bitorder="little")
            rows[without] = 0
            present = np.packbits(rows, bitorder="little").view(np.uint64)
        by_place: dict[int, list[np.ndarray]] = {}
        size = np.abs(query)
        flipped = query < 0  # a negative weight counts what is missing to the largest value
        for i in range(int(size.max(initial=0)).bit_length()):
            has = size >> i & 1 == 1
            for flip in (False, True):
                own = self.slices[has & (flipped == flip)]
                if len(own):
                    for j in range(own.shape[1]):
                        by_place.setdefault(i + j, []).append(~own[:, j] & self.present if flip else own[:, j])
        lost = int(size.sum()) * ((1 << self.coarse) - 1)
        hit = _candidates(_added(by_place), present, k, -(-lost >> self.coarse) + 1)
        return np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = 16_384, query_rows: int = 512) -> DataFrame:
    """k best ids of `vectors` (id, v) for each id of `queries` (id, v), its own rows left out: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    by_id = Window.partitionBy("v").orderBy("id")  # a limit on row_number is applied before the shuffle too
    few = vectors.dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = written(distinct, "vectors")
    n_blocks = max(1, -(-index.count() // block_rows))
    queries = written(queries.dropDuplicates(["id", "v"]), "queries")
    n_groups = max(1, -(-queries.count() // query_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    blocks = index.groupBy(deal("v", n_blocks).alias("block"), F.size("v").alias("dims")).agg(
        F.collect_list(F.struct("v", "ids")).alias("rows")
    )  # about block_rows each
    groups = queries.groupBy(deal("id", n_groups).alias("group"), F.size("v").alias("dims")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    sent = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = sent.join(blocks, ["block", "dims"]).select("rows", "queries")

    def score(frames):
        for b in frames:
            for i in range(b.num_rows):
                rows, asked = b.column("rows")[i].values, b.column("queries")[i].values
                values = _matrix(rows.field("v"))
                ids = rows.field("ids").to_pylist()
                block = Block(values)
                out = []
                alone: dict[int, list[int]] = {}  # rows that only one id holds
                for r, own in enumerate(ids):
                    if len(own) == 1:
                        alone.setdefault(own[0], []).append(r)
                for q, w in zip(asked.field("id").to_pylist(), _matrix(asked.field("v")), strict=True):
                    without = alone.get(q, [])
                    n = k
                    while True:  # rows that hold the n best scores, each with another id than q; an id may hold several
                        hit = block.top(w, n, without)
                        exact = values[hit] @ w
                        if len(hit) > n:  # by score; rows that tie with the last one stay
                            hit, exact = (x[exact >= np.partition(exact, -n)[-n]] for x in (hit, exact))
                        best_of: dict[int, int] = {}
                        for h, s in zip(hit, exact, strict=True):
                            for v in ids[h]:
                                if v != q:
                                    best_of[v] = max(int(s), best_of.get(v, int(s)))
                        if len(best_of) >= k or n >= len(ids):
                            break
                        n *= 2
                    out += [(q, v, -s) for s, v in sorted((-s, v) for v, s in best_of.items())[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = met.mapInArrow(score, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)
