"""Chosen places of a similarity ranking, and its histogram, without ranking the whole database for a query.

Similarities are rounded, so a query's ranking is known from how often each rounded value occurs.  A task holds a group
of queries and reads the whole database past it, so counts stay in the task: they are returned as histograms, or turned
into the value on which a wanted place falls and the place among the items that share it.  A second pass reads the
database in the order of ids, counts the items of those values, and returns the one at the place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators import meet
from tandem.operators._shared import written
from tandem.operators.vector_blocks import _matrix, unit

#: Bytes of the counts that a task holds.
COUNT_BYTES = 96 << 20


def _span(digits: int) -> int:
    """Rounded values from -10**digits - 1 to 10**digits + 1."""
    return 2 * 10**digits + 3


def _values(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """Places from 0 of the rounded cosines of two matrices of unit norm, in units of the last digit."""
    return np.rint(np.round(x @ y.T, digits) * 10**digits).astype(np.int64) + 10**digits + 1


def _past(queries: DataFrame, database: DataFrame, held_rows: int) -> DataFrame:
    """The database, in id order, past each group of queries (item_id, vec, more); groups have about held_rows at most."""
    as_long = lambda df: df.withColumns({"item_id": F.col("item_id").cast("long"), "vec": F.col("vec").cast("array<double>")})
    n = queries.count()
    groups = max(1, min(n, meet.tasks(queries.sparkSession)), -(-n // max(1, held_rows)))
    return meet.dealt(as_long(queries), as_long(database.select("item_id", "vec")), groups, 1)


def _joined(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def _ids(col) -> np.ndarray:
    return col.to_numpy()


def _counted(queries: DataFrame, database: DataFrame, digits: int, block_rows: int, result: Callable, schema: str) -> DataFrame:
    """result(the queries' table, first row, counts by value) for some queries at a time."""
    span, shift = _span(digits), 10**digits + 1
    at_once = max(1, min(256, (1 << 22) // span))

    def hold(batches):
        t = _joined(batches)
        return t, unit(_matrix(t.column("vec").combine_chunks())), np.zeros((len(t), span), np.int32)

    def count(held, batch):
        _, x, n = held
        for at in range(0, batch.num_rows, block_rows):
            y = unit(_matrix(batch.column("vec").slice(at, block_rows)))
            for i in range(0, len(x), at_once):
                v = _values(x[i : i + at_once], y, digits)
                own = len(v)
                n[i : i + own] += np.bincount((v + np.arange(own)[:, None] * span).ravel(), minlength=own * span).reshape(own, span).astype(np.int32)
        return ()

    def end(held):
        t, _, n = held
        for i in range(0, len(n), at_once):
            yield pa.RecordBatch.from_pydict(result(t, i, n[i : i + at_once], shift))

    both = _past(queries, database, COUNT_BYTES // (4 * span))
    return both.mapInArrow(lambda frames: meet.against(frames, hold, count, end), schema)


def value_counts(queries: DataFrame, database: DataFrame, digits: int = 4, block_rows: int = 8192) -> DataFrame:
    """query_id, value (the rounded cosine in units of its last digit) and n."""

    def result(t, i, n, shift):
        r, v = np.nonzero(n)
        return {"query_id": _ids(t.column("item_id"))[i + r], "value": v - shift, "n": n[r, v].astype(np.int64)}

    return _counted(queries.select("item_id", "vec"), database, digits, block_rows, result, "query_id long, value long, n long")


def histogram(queries: DataFrame, database: DataFrame, bins: int, digits: int = 4, block_rows: int = 8192) -> DataFrame:
    """query_id, bin (of equal ones from -1 to 1, the last one closed) and n."""

    def result(t, i, n, shift):
        value = np.round((np.arange(n.shape[1]) - shift) / 10.0**digits, digits)
        of = np.minimum(np.floor((value + 1) / 2 * bins), bins - 1).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        n = np.add.reduceat(n.astype(np.int64), starts, axis=1)
        r, b = np.nonzero(n)
        return {"query_id": _ids(t.column("item_id"))[i + r], "bin": of[starts][b].astype(np.int32), "n": n[r, b]}

    return _counted(queries.select("item_id", "vec"), database, digits, block_rows, result, "query_id long, bin int, n long")


def places(queries: DataFrame, database: DataFrame, wanted: DataFrame, digits: int = 4, block_rows: int = 8192) -> DataFrame:
    """query_id, target_id, sim and rank of the wanted (query_id, rank): by falling rounded cosine, ties to the smaller id."""
    ranks = wanted.groupBy(F.col("query_id").alias("item_id")).agg(F.collect_list(F.col("rank").cast("long")).alias("ranks"))
    asked = queries.select("item_id", "vec").join(ranks, "item_id")

    def needs(t, i, n, shift):
        to = np.cumsum(n[:, ::-1].astype(np.int64), axis=1)  # items down to each value
        out = []
        for k, wanted in enumerate(t.column("ranks").slice(i, len(n)).to_pylist()):
            for rank in wanted:
                if 1 <= rank <= to[k, -1]:
                    at = int(np.searchsorted(to[k], rank))
                    out.append((i + k, n.shape[1] - 1 - at - shift, rank - (int(to[k, at - 1]) if at else 0), rank))
        q, value, deep, rank = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((),) * 4))
        return {"query_id": _ids(t.column("item_id"))[q], "value": value, "deep": deep, "rank": rank}

    found = written(_counted(asked, database, digits, block_rows, needs, "query_id long, value long, deep long, rank long"), "wanted-places")
    listed = found.groupBy(F.col("query_id").alias("item_id")).agg(F.collect_list(F.struct("value", "deep", "rank")).alias("needs"))
    shift = 10**digits + 1

    def hold(batches):
        t = _joined(batches)
        lists = t.column("needs").combine_chunks()
        n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        value, deep, rank = (flat.field(c).to_numpy() for c in ("value", "deep", "rank"))
        return _ids(t.column("item_id")), unit(_matrix(t.column("vec").combine_chunks())), np.repeat(np.arange(len(n)), n), value + shift, deep, rank, np.zeros(len(deep), np.int64)

    def pick(held, batch):
        ids, x, query, value, deep, rank, seen = held
        own = _ids(batch.column("item_id"))
        for at in range(0, batch.num_rows, block_rows):
            y = unit(_matrix(batch.column("vec").slice(at, block_rows)))
            for i in range(0, len(x), 64):
                v = _values(x[i : i + 64], y, digits).astype(np.int32)
                lo, hi = np.searchsorted(query, [i, i + 64])
                for j in range(lo, hi, 512):
                    some = slice(j, min(hi, j + 512))
                    hit = v[query[some] - i] == value[some, None]
                    n = np.count_nonzero(hit, axis=1)
                    here = np.flatnonzero((seen[some] < deep[some]) & (seen[some] + n >= deep[some]))
                    target = [own[at + np.flatnonzero(hit[k])[deep[j + k] - seen[j + k] - 1]] for k in here.tolist()]
                    seen[some] += n
                    if target:
                        yield pa.RecordBatch.from_pydict({"query_id": ids[query[j + here]], "target_id": np.array(target), "value": value[j + here] - shift, "rank": rank[j + here]})

    both = _past(queries.select("item_id", "vec").join(listed, "item_id"), database, 4096)
    placed = both.mapInArrow(lambda frames: meet.against(frames, hold, pick), "query_id long, target_id long, value long, rank long")
    return placed.select("query_id", "target_id", F.round(F.col("value") / float(10**digits), digits).alias("sim"), "rank")
