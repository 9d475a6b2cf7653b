"""Sums and maxima of whole vectors by item: two merged steps on Arrow batches.

Words come with their vector once for each chunk of items that hold them.  A task adds the vectors up by item over its
batch, one row an item; those rows are sent to their items' tasks, sorted, and merged along the sorted rows.

Where words share vectors, items meet ids of vectors instead: a task holds a group of vectors and reads items past it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators import meet
from tandem.operators._shared import written

_FOLD = {"sum": np.add, "max": np.maximum}


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))


def _partial(dim: int, op: str, rows: int = 65_536):
    fold = _FOLD[op]

    def add(frames):
        for b in frames:
            vecs, items = b.column(0), b.column(1)
            known = ~vecs.is_null().to_numpy(zero_copy_only=False)
            x = np.zeros((b.num_rows, dim))  # an unknown word is a row of zeros
            x[known] = _matrix(vecs.drop_null(), dim)
            sizes = np.diff(items.offsets.to_numpy())
            word, item = np.repeat(np.arange(b.num_rows), sizes), items.flatten()
            for at in range(0, len(word), rows):
                part = item.slice(at, rows).dictionary_encode()
                code = part.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                starts = np.searchsorted(code[order], np.arange(len(part.dictionary)))
                out = fold.reduceat(x[word[at : at + rows][order]], starts, axis=0)
                yield pa.RecordBatch.from_arrays([part.dictionary, pa.array(np.bincount(code)), _lists(out)], names=["item_id", "n", "vec"])

    return add


def _merged(dim: int, op: str, mean: bool):
    fold = _FOLD[op]

    def out(ids, n, x):
        return pa.RecordBatch.from_arrays([ids, _lists(x / n[:, None] if mean else x)], names=["item_id", "vec"])

    def merge(frames):
        held = None  # the last item may go on in the next batch
        for b in frames:
            if not b.num_rows:
                continue
            ids, n, x = b.column(0), b.column(1).to_numpy(), _matrix(b.column(2), dim)
            if held is not None:
                ids, n, x = pa.concat_arrays([held[0], ids]), np.r_[held[1], n], np.concatenate([held[2], x])
            codes = ids.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            first = ids.take(pa.array(starts))
            n, x = np.add.reduceat(n, starts), fold.reduceat(x, starts, axis=0)
            if len(starts) > 1:
                yield out(first[:-1], n[:-1], x[:-1])
            held = first[-1:], n[-1:], x[-1:]
        if held is not None:
            yield out(*held)

    return merge


def pooled(words: DataFrame, word_vectors: DataFrame, dim: int, op: str, chunk_items: int = 4096) -> DataFrame:
    """item_id and vec of (item_id, word), whose rows are distinct; op is max, sum or avg.

    A word's items are dealt to chunks by their hash, so many that even a word of every item has about `chunk_items` a
    chunk; the vector is sent with each chunk.
    """
    kind = words.schema["item_id"].dataType.simpleString()
    chunks = max(1, -(-(words.agg(F.approx_count_distinct("item_id")).first()[0] or 0) // chunk_items))
    chunk = F.pmod(F.xxhash64("item_id"), F.lit(chunks))
    listed = words.groupBy("word", chunk.alias("_chunk")).agg(F.collect_list("item_id").alias("items"))  # about chunk_items at most
    step = "max" if op == "max" else "sum"
    met = listed.join(word_vectors.select("word", F.col("vec").cast("array<double>").alias("vec")), "word", "left").select("vec", "items")
    return _sums(met.mapInArrow(_partial(dim, step), f"item_id {kind}, n long, vec array<double>"), dim, op)


def _sums(parts: DataFrame, dim: int, op: str) -> DataFrame:
    """item_id and vec of the parts (item_id, n, vec) of each item."""
    kind, step = parts.schema["item_id"].dataType.simpleString(), "max" if op == "max" else "sum"
    ordered = parts.repartition("item_id").sortWithinPartitions("item_id")
    return ordered.mapInArrow(_merged(dim, step, op == "avg"), f"item_id {kind}, vec array<double>")


def _held_sums(dim: int, op: str):
    fold = _FOLD[op]

    def hold(batches):
        batches = [b.filter(b.column("vec").is_valid()) for b in batches]  # one row of each group has none
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in batches])
        x = np.concatenate([_matrix(b.column("vec"), dim) for b in batches])
        order = np.argsort(ids, kind="stable")
        return ids[order], np.concatenate([x[order], np.zeros((1, dim))])

    def add(held, b):
        ids, x = held
        own = b.column("vec_id")
        known = ~own.is_null().to_numpy(zero_copy_only=False)
        own = own.fill_null(0).to_numpy()
        at = np.searchsorted(ids, own)
        at[~known | (np.r_[ids, 0][at] != own)] = len(ids)  # an unknown word is a row of zeros
        codes = b.column("item_id").dictionary_encode().indices.fill_null(-1).to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        n = b.column("n").to_numpy()
        rows = x[at] if op == "max" else x[at] * n[:, None]
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(starts)), pa.array(np.add.reduceat(n, starts)), _lists(fold.reduceat(rows, starts, axis=0))], names=["item_id", "n", "vec"])

    return lambda frames: meet.against(frames, hold, add)


def pooled_by_id(words: DataFrame, word_ids: DataFrame, vectors: DataFrame, dim: int, op: str, group_bytes: int = meet.GROUP_BYTES) -> DataFrame:
    """item_id and vec of (item_id, word), whose rows are distinct, by (word, vec_id) and (vec_id, vec); op is max, sum or avg.

    Only the ids of vectors are sent with the words. Vectors that some word has are dealt to groups; a group is sent to
    each group of items, and an item's words to the group that their vector is in.
    """
    spark, kind = words.sparkSession, words.schema["item_id"].dataType.simpleString()
    ids = written(word_ids.select("word", F.col("vec_id").cast("long").alias("vec_id")), "word-ids")
    used = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).join(ids, "vec_id", "left_semi"), "used-vectors")
    n_left = max(1, -(-used.count() * dim * 8 // group_bytes))
    n_right = max(meet.tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = used.withColumn("_group", meet.group_of(n_left, "vec_id"))
    none = spark.range(n_left).select(F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("vec"), F.col("id").cast("int").alias("_group"))
    left = left.where("vec IS NOT NULL").unionByName(none)  # so that each group has a row
    left = left.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    pair = F.col("_group") * n_right + F.col("_to")
    left = left.select(pair.alias("pair"), F.lit(0).alias("side"), F.lit(-1).cast("long").alias("_at"), F.lit(None).cast(kind).alias("item_id"), "vec_id", F.lit(0).cast("long").alias("n"), "vec")
    coded = words.join(ids.hint("shuffle_hash"), "word", "left").groupBy("item_id", "vec_id").agg(F.count("*").alias("n"))
    coded = coded.withColumn("_group", F.coalesce(meet.group_of(n_left, "vec_id"), F.lit(0))).withColumn("_to", meet.group_of(n_right))
    at = F.xxhash64("item_id").bitwiseAND(F.lit((1 << 63) - 1))  # one number to sort by: vectors first, then an item's rows together
    right = coded.select(pair.alias("pair"), F.lit(1).alias("side"), at.alias("_at"), "item_id", "vec_id", "n", F.lit(None).cast("array<double>").alias("vec"))
    both = left.unionByName(right).repartitionById(n_left * n_right, F.col("pair").cast("int")).sortWithinPartitions("_at").drop("_at")
    parts = both.mapInArrow(_held_sums(dim, "max" if op == "max" else "sum"), f"item_id {kind}, n long, vec array<double>")
    return _sums(parts, dim, op)
