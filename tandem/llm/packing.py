"""Best-fit packing of documents into sequences of a fixed length, planned on a histogram of lengths.

`cut` turns each document into pieces of at most `capacity` tokens; only longer documents are cut.  `plan` runs
best-fit decreasing over the counts of each length: at most `capacity` numbers, however many documents there are.
It places whole intervals of equal pieces at once and yields rows (length, first rank, last rank, first sequence,
offset).  `pack` then numbers the pieces of each length and looks their interval up.

Null text counts as empty: such a document has the end id only.  A null doc_id is kept as null.  Rows that share a
doc_id are packed each on its own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm._common import batches, written
from tandem.llm._tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, byte_level: bool = False) -> DataFrame:
    """Pieces of each document's ids (its text's, then `end_id`): doc_id, piece, start, length, ids_crc32."""

    def cut_batches(frames):
        enc = encoder(tokenizer, byte_level)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches(frames):
            rows = []
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").fill_null("").to_pylist()), strict=True):
                x += end
                for piece, at in enumerate(range(0, len(x), 4 * capacity)):
                    own = x[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            cols = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))
        enc.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_batches, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, offset), ranks from 0."""
    out, used = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # room left: intervals of sequences
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for room in sorted(r for r in free if r >= length):
            while left and free[room]:
                a, b = free[room].pop()
                each = min(room // length, left)  # the room that stays is the smallest that fits: fill it first
                n = min(left // each, b - a)
                if n < b - a:
                    free[room].append((a + n, b))
                for i in range(each):
                    out.append((length, rank, rank + n, a, capacity - room + i * length))
                    rank += n
                free.setdefault(room - each * length, []).append((a, a + n))
                left -= n * each
            if not left:
                break
        while left:  # new sequences, each with as many of this length as fit
            each = min(capacity // length, left)
            n = left // each
            for i in range(each):
                out.append((length, rank, rank + n, used, i * length))
                rank += n
            free.setdefault(capacity - each * length, []).append((used, used + n))
            used, left = used + n, left - n * each
    return out


def pack(pieces: DataFrame, capacity: int = 2048, spread: int = 64, group_rows: int = 1_000_000) -> DataFrame:
    """Add sequence_id and offset to `pieces`.

    Pieces of one length are numbered in groups of about equal size, whose first numbers are prefix sums of their
    counts.  There are so many groups that even a length that all rows share has `group_rows` a group at most, and
    `spread` at least.  Rows are dealt to groups by where they were written, so equal ids don't meet.
    """
    pieces = written(pieces.withColumn("_scatter", F.monotonically_increasing_id()), "pieces")
    spread = max(spread, -(-pieces.count() // group_rows))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("_scatter"), F.lit(spread)).cast("int"))
    groups = pieces.groupBy("length", "group").count()
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # <= capacity rows
    rows = plan(counts, capacity)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    first = {int(x): int(i) for x, i in zip(*np.unique(table[:, 0], return_index=True), strict=True)}
    key = table[:, 0] << 44 | table[:, 1]
    names = [*pieces.columns[:5], "sequence_id", "offset"]

    def place(frames):
        for b in frames:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            hit = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
            cols = [b.column(c) for c in names[:5]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], names)

    assert len(first) == len(counts)
    own = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32", "_scatter")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["length", "group"])
    ranked = ranked.select(*names[:5], (F.col("rank") + F.col("base")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
