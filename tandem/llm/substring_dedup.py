"""Substring dedup: remove words of passages of k words that start earlier elsewhere, with a count-min prefilter.

1. Each task hashes the windows of its documents into cells and emits its part of a count-min sketch, cut by shard of
   the cell range: the cells it has counted, once or more often, each with the chunk (a hash of the document) that it
   is from.  A shard's parts are merged by adding; counts are never too small, so a window that repeats is never missed.
   The reply to a chunk lists those of its cells that were counted twice or more.  The number of cells grows with the
   input (`cells` for each window), a shard's memory does not.  A row holds all that a task (a shard) has for a shard
   (a chunk), so there are at most as many rows as windows (listed windows), and far fewer unless the input is huge.
2. Each chunk meets its reply.  Windows whose cell is listed are sent on, each distinct one once for each chunk, with
   the first document of the chunk that has it.  They are grouped exactly (96 bits of hash), and the reply says which
   of them start earlier in another chunk.
3. Each chunk meets both replies and removes the covered words.

All windows of a document count, whatever its length.  What is sent for one window is at most one row for each chunk,
so a passage that a third of all documents share does not gather in one task.  Exact copies of an earlier document
are known from hashes of their text and send nothing.

Words are `[^\\x20\\x09-\\x0D]+`.  "Earlier" is a smaller doc_id (null before all), or an earlier start in the same
document; rows that share a doc_id but not the text are ordered by a hash of the text, and equal rows count as one
document and get equal results.  Null text counts as empty.  Documents under k words stay as they are.  An empty table
gives no rows.  Other columns are kept.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tandem.llm._common import BLANK_SEPARATED, batches, release, row_starts, text_bytes, window_hashes, word_hashes, written

SHARD = 1 << 26  # cells of a shard
FLUSH = 2_000_000  # windows that a task holds before it emits their cells
HASHED = 500_000  # bytes of text whose words are held at once
PART = 1 << 20  # bytes of kept text, or of cells, that go back to Spark at once
NO_ID = -(2**63)


def _windows(col: pa.Array, k: int):
    """Row, start and hash (64 and 32 bits) of all windows of the rows' words, and the number of words of each row."""
    buf, offs = text_bytes(col)
    _, _, row, a, b = word_hashes(buf, offs, BLANK_SEPARATED, salts=(0, 1))
    starts = row_starts(row, len(col))
    h1, h2 = window_hashes(a, k), (window_hashes(b, k) >> np.uint64(32)).astype(np.uint32)
    own = np.flatnonzero(row[: len(h1)] == row[k - 1 :]) if len(h1) else np.zeros(0, int)
    return row[own], own - starts[row[own]], h1[own], h2[own], np.diff(starts)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte."""
    x = x.astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join(x[:, i].tobytes() for i in (3, 2, 1, 0))


def _numbers(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, n)[::-1].T).view("<u4").ravel()


def _packed(cells: np.ndarray, chunks: np.ndarray | None = None, often: np.ndarray | None = None) -> bytes:
    """Cells in order, and a chunk and a bit for each."""
    data = _planes(np.diff(cells.astype(np.int64), prepend=0))
    if chunks is not None:
        data += _planes(chunks) + np.packbits(often).tobytes()
    return zlib.compress(data, 1)


def _unpacked(data: bytes, n: int, cells_only: bool = True):
    x = np.frombuffer(zlib.decompress(data), np.uint8)
    cells = np.cumsum(_numbers(x[: 4 * n], n), dtype=np.int64)
    return cells if cells_only else (cells, _numbers(x[4 * n : 8 * n], n).astype(np.int64), np.unpackbits(x[8 * n :])[:n])


def _cuts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, int)
    return cut, np.append(cut[1:], len(x)) if len(cut) else cut


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def _rows(schema_names, kinds, rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], schema_names)


_SKETCH = ["shard", "n", "cells"]
_SKETCH_KINDS = [pa.int64(), pa.int64(), pa.binary()]
_SENT = ["bucket", "chunk", "n", "data"]
_SENT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_REPLY = ["chunk", "kind", "part", "n", "data"]
_REPLY_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
_REPLY_SCHEMA = "chunk long, kind string, part long, n long, data binary"


def _sketch(total: int, chunks: int, k: int):
    """Task side of the sketch: batches of (_chunk, text) to its parts."""

    single = total * chunks < 1 << 63  # cell and chunk then sort as one number

    def ordered(held: list):
        """For each shard: cell and chunk of each distinct pair in order, and whether it occurs more than once."""
        if single:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            bounds = np.searchsorted(keys, np.arange(total // SHARD + 1) * (SHARD * chunks))
            for shard in np.flatnonzero(np.diff(bounds)):
                own = keys[bounds[shard] : bounds[shard + 1]]
                first, end = _cuts(own)
                own = own[first]
                yield int(shard), own // chunks % SHARD, own % chunks, end - first > 1
            return
        cells, own = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((own, cells))
        cells, own = cells[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (own[1:] != own[:-1]))))
        cells, own, often = cells[first], own[first], np.diff(first, append=len(cells)) > 1
        for s, e in zip(*_cuts(cells // SHARD), strict=True):
            yield int(cells[s]) // SHARD, cells[s:e] % SHARD, own[s:e], often[s:e]

    def emit(held: list):
        rows, size = [], 0
        for shard, cells, own, often in ordered(held):
            rows.append((shard, len(cells), _packed(cells, own, often)))
            size += len(rows[-1][2])
            if size >= PART:
                yield _rows(_SKETCH, _SKETCH_KINDS, rows)
                rows, size = [], 0
        if rows:
            yield _rows(_SKETCH, _SKETCH_KINDS, rows)

    def sketch(frames):
        held, n = [], 0
        for b in batches(frames, HASHED):
            row, _, h1, _, _ = _windows(b.column("text"), k)
            cells, own = (h1 % np.uint64(total)).astype(np.int64), b.column("_chunk").to_numpy()[row]
            held.append(cells * chunks + own if single else (cells, own))
            n += len(row)
            if n >= FLUSH:
                yield from emit(held)
                release()
                n = 0
        if n:
            yield from emit(held)
        release()

    return sketch


def _merge(table: pa.Table) -> pa.Table:
    """Add the parts of one shard; reply to each chunk with its cells that were counted twice or more."""
    parts = [_unpacked(d.as_py(), n.as_py(), False) for d, n in zip(table.column("cells"), table.column("n"), strict=True)]
    cells, chunks, often = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    own = np.sort(cells)
    twice = np.unique(np.concatenate((own[1:][own[1:] == own[:-1]], cells[often > 0])))
    del own, often
    hot = np.zeros(len(cells), bool)
    if len(twice):
        hot = twice[np.minimum(np.searchsorted(twice, cells), len(twice) - 1)] == cells
    keys = np.unique(chunks[hot] * SHARD + cells[hot])
    chunks, cells = keys // SHARD, keys % SHARD
    shard = table.column("shard")[0].as_py()
    rows = [(int(chunks[s]), "cells", shard, int(e - s), _packed(cells[s:e])) for s, e in zip(*_cuts(chunks), strict=True)]
    release()
    return pa.Table.from_batches([_rows(_REPLY, _REPLY_KINDS, rows)])


class _Chunk:
    """The windows of a chunk's documents whose cells are listed; first: the first of each distinct one."""

    def __init__(self, docs: pa.Table, replies: pa.Table, total: int, k: int, buckets: int):
        kinds = replies.column("kind").to_pylist()
        rows = list(zip(kinds, *(replies.column(c).to_pylist() for c in ("part", "n", "data")), strict=True))
        hot = [_unpacked(d, n) + part * SHARD for part, n, d in sorted(r[1:] for r in rows if r[0] == "cells")]
        hot = np.concatenate(hot) if hot else np.zeros(0, np.int64)
        del replies
        copies = {np.frombuffer(d, "<i8").tobytes() for kind, _, _, d in rows if kind == "copy"}
        self.bits = {part: np.unpackbits(np.frombuffer(d, np.uint8))[:n].astype(bool) for kind, part, n, d in rows if kind == "later"}

        ids = docs.column("_id").combine_chunks().to_numpy()
        ties = docs.column("_tie").combine_chunks().to_numpy()
        self.order = np.lexsort((ties, ids))
        self.docs = docs.take(pa.array(self.order))
        self.ids, self.ties = ids[self.order], ties[self.order]
        n = len(ids)
        self.same = np.zeros(n, bool)  # as the row before
        self.same[1:] = (self.ids[1:] == self.ids[:-1]) & (self.ties[1:] == self.ties[:-1])
        self.copy = np.zeros(n, bool)
        if copies:
            self.copy = np.array([np.array([i, t], "<i8").tobytes() in copies for i, t in zip(self.ids, self.ties, strict=True)])
        near = np.zeros(1 << 23, bool)
        near[hot & (len(near) - 1)] = True
        rows_, starts, h1s, h2s, words, at = [], [], [], [], [], 0
        for b in batches(self.docs.select(["text"]).to_batches(), HASHED):
            row, start, h1, h2, n_words = _windows(b.column("text"), k)
            cell = (h1 % np.uint64(total)).astype(np.int64)
            keep = np.flatnonzero(near[cell & (len(near) - 1)] & ~(self.same | self.copy)[row + at])
            if len(hot):
                found = np.searchsorted(hot, cell[keep])
                found[found == len(hot)] = 0
                keep = keep[hot[found] == cell[keep]]
            for to, x in ((rows_, row[keep] + at), (starts, start[keep]), (h1s, h1[keep]), (h2s, h2[keep]), (words, n_words)):
                to.append(x)
            at += len(n_words)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.n_words = cat(words, np.int64)
        self.row, self.start = cat(rows_, np.int64), cat(starts, np.int64)
        h1, h2 = cat(h1s, np.uint64), cat(h2s, np.uint32)
        by_hash = np.lexsort((h2, h1))
        a, b = h1[by_hash], h2[by_hash]
        lead = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        first = np.zeros(len(h1), bool)
        first[by_hash[lead]] = True
        self.first = first
        own = np.flatnonzero(first)
        bucket = (h1[own] >> np.uint64(20)) % np.uint64(buckets)
        self.sent = own[np.argsort(bucket, kind="stable")]
        self.bucket = np.sort(bucket).astype(np.int64)
        self.h1, self.h2 = h1, h2

    def parts(self):
        """Bucket and positions of what is sent to it."""
        for s, e in zip(*_cuts(self.bucket), strict=True):
            yield int(self.bucket[s]), self.sent[s:e]


def _group(table: pa.Table) -> pa.Table:
    """Exact groups of one bucket; reply which of the sent windows start earlier in another chunk."""
    ns, parts = table.column("n").to_pylist(), []
    for n, d in zip(ns, table.column("data").to_pylist(), strict=True):
        d = zlib.decompress(d)
        parts.append([np.frombuffer(d, t, n, at * n) for t, at in (("<u8", 0), ("<i8", 8), ("<i8", 16), ("<u4", 24))])
    h1, ids, ties, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ties, ids, h2, h1))
    lead = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
    later = np.ones(len(h1), bool)
    later[order[lead]] = False
    del parts, h1, ids, ties, h2, order
    rows, at, bucket = [], 0, table.column("bucket")[0].as_py()
    for chunk, n in zip(table.column("chunk").to_pylist(), ns, strict=True):
        if later[at : at + n].any():
            rows.append((chunk, "later", bucket, n, np.packbits(later[at : at + n]).tobytes()))
        at += n
    release()
    return pa.Table.from_batches([_rows(_REPLY, _REPLY_KINDS, rows)])


def remove_repeats(docs: DataFrame, k: int = 20, cells: int = 32, chunk_bytes: int = 16 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text, the words that stay joined by one space."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // 6 * cells // SHARD))
    total = shards * SHARD
    cores = spark.sparkContext.defaultParallelism
    chunks = max(-(-size // chunk_bytes), min(2 * cores, -(-size // (1 << 20))), 1)
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")  # whatever their names
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie"), "text", others)
    keyed = keyed.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_tie"), F.lit(chunks)))

    parts = keyed.select("_chunk", "text").mapInArrow(_sketch(total, chunks, k), "shard long, n long, cells binary")
    hot = parts.groupBy("shard").applyInArrow(_merge, _REPLY_SCHEMA)

    marks = keyed.where(F.octet_length("text") > 0).select("_chunk", "_id", "_tie", F.xxhash64(F.reverse("text")).alias("_tie2"))
    firsts = marks.groupBy("_tie", "_tie2").agg(F.min("_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    firsts = written(firsts, "copies")  # an aggregate apart from the join, whose hot keys can then be split
    near = F.broadcast(firsts) if firsts.count() <= broadcast_rows else firsts
    later = marks.join(near, ["_tie", "_tie2"]).where(F.col("_id") > F.col("first"))
    as_bytes = lambda c: F.reverse(F.unhex(F.lpad(F.hex(c), 16, "0")))  # noqa: E731  little-endian
    copies = later.select(
        F.col("_chunk").alias("chunk"), F.lit("copy").alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("n"),
        F.concat(as_bytes(F.col("_id")), as_bytes(F.col("_tie"))).alias("data"),
    )
    known = written(hot.unionByName(copies), "cells")

    def send(_, docs, replies):
        c = _Chunk(docs, replies, total, k, chunks)
        rows, chunk = [], docs.column("_chunk")[0].as_py() if docs.num_rows else 0
        for bucket, own in c.parts():
            data = b"".join(x.tobytes() for x in (c.h1[own], c.ids[c.row[own]], c.ties[c.row[own]], c.h2[own]))
            rows.append((bucket, chunk, len(own), zlib.compress(data, 1)))
        del c
        release()
        return pa.Table.from_batches([_rows(_SENT, _SENT_KINDS, rows)])

    text = keyed.select("_chunk", "_id", "_tie", "text").groupBy("_chunk")
    sent = text.cogroup(known.groupBy("chunk")).applyInArrow(send, "bucket long, chunk long, n long, data binary")
    replies = known.unionByName(written(sent.groupBy("bucket").applyInArrow(_group, _REPLY_SCHEMA), "replies"))

    names = ["text", "_row"]

    def cut(_, docs, replies):
        c = _Chunk(docs, replies, total, k, chunks)
        gone = ~c.first
        for bucket, own in c.parts():
            if bucket in c.bits:
                gone[own] = c.bits[bucket]
        row, start = c.row[gone], c.start[gone]
        by_row = np.argsort(row, kind="stable")
        row, start = row[by_row], start[by_row]
        bounds = np.searchsorted(row, np.arange(len(c.ids) + 1))
        kept, kept_bytes, done, removed = [], 0, [], np.zeros(len(c.ids), np.int64)
        for i, text in enumerate(c.docs.column("text").cast(pa.binary())):
            if kept_bytes >= PART:  # the result goes back in parts
                done.append(_strings(kept))
                kept, kept_bytes = [], 0
            words = (text.as_py() or b"").split()  # bytes are split at the six ASCII blanks
            n = len(words)
            if c.same[i]:
                kept.append(stayed)
                kept_bytes += len(stayed)
                removed[i] = removed[i - 1]
                continue
            if c.copy[i]:
                words, removed[i] = ([], n) if n >= k else (words, 0)
            elif bounds[i] < bounds[i + 1]:
                edge = np.zeros(n + 1, np.int32)
                own = start[bounds[i] : bounds[i + 1]]
                np.add.at(edge, own, 1)
                np.add.at(edge, own + k, -1)
                stays = np.cumsum(edge[:-1]) == 0
                removed[i] = n - int(stays.sum())
                words = compress(words, stays)
            stayed = b" ".join(words)
            kept.append(stayed)
            kept_bytes += len(stayed)
        done.append(_strings(kept))
        out = c.docs.select(names)
        for name, x in (("n_words", pa.array(c.n_words, pa.int64())), ("n_removed", pa.array(removed)), ("kept_text", pa.chunked_array(done))):
            out = out.append_column(name, x)
        del c, kept
        release()
        return out

    schema = StructType([StructField("text", StringType()), keyed.schema["_row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    out = keyed.groupBy("_chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, schema)
    new = ("n_words", "n_removed", "kept_text")  # these replace columns of the same name
    return out.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in new], *new)
