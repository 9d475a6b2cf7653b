"""Helpers shared by the training-data operators: shared storage, Arrow access, numpy word hashing.

Everything here is small per-task code.  The words of a whole Arrow batch are found and hashed with numpy, a
segment of about one megabyte at a time, so a task's memory does not depend on how many rows it reads.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are hashed at once.
SEGMENT = 1 << 16
#: Rows that Spark sends to a task's Python at once while a table is written; texts can be long.
ARROW_ROWS = 2_000
_MUL = 0x9E3779B97F4A7C15


def _give_back() -> None:
    """Large blocks go back to the system when they are freed: glibc otherwise keeps ever larger ones, and Arrow's own pool what it once had.

    Of smaller ones 16 MB stay with the process; without that each array would be given back and fetched again.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which then stays as it is
        ctypes.CDLL(None).mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


_give_back()
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (`spark.checkpoint.dir`); where it is unset, a local one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tandem-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_made: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that the operators have left in the shared folder; to be called when their results have been read."""
    for path in list(_made):
        _delete(spark, path)


_blocks: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("blocks", default=())


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables `written` in this block are deleted at its end, so nothing that is lazy may read them after it."""
    paths: list[str] = []
    token = _blocks.set((*_blocks.get(), paths))
    try:
        yield
    finally:
        _blocks.reset(token)
        for path in paths:
            _delete(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What is run in this block sends at most ARROW_ROWS rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, outlives: int = 0) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, and survives lost executors.

    The table outlives so many of the innermost `temporary` blocks; it stays if there are no more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    blocks = _blocks.get()
    if outlives < len(blocks):
        blocks[-1 - outlives].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """`df`, which has about `rows` rows, in at most a task for `each` of them, twice the cores at least: the number of
    shuffle partitions, however large, then costs little on small tables. Nothing is shuffled."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def bucketed(df: DataFrame, name: str, n: int, keys: list[str]) -> DataFrame:
    """Write `df` in n buckets by `keys` and read it back: joins on the keys need no exchange on this side.

    The files lie in the shared folder and are deleted with the innermost `temporary` block; the catalogue's entry goes
    at once, as what is returned knows its files.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if blocks := _blocks.get():
        blocks[-1].append(path)
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return out


def release() -> None:
    """Give freed memory back at a task's end: the worker process goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n+1 offsets of its rows."""
    col = col.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def char_classes(*classes: str | bytes | range, rest: int = 1) -> np.ndarray:
    """Class of each byte: 0 for the first set, which separates words, 2, 3, ... for later ones, else `rest`."""
    out = np.full(256, rest, np.uint8)
    for i, c in enumerate(classes):
        out[list(c.encode("latin-1") if isinstance(c, str) else c)] = i and i + 1
    return out


#: `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = char_classes(b"\x20\x09\x0a\x0b\x0c\x0d")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM_WORDS = char_classes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Runs of letters, digits and non-ASCII characters, and runs of ASCII punctuation.
WORD_PUNCT = char_classes([*range(0x21), 0x7F], [b for b in range(0x21, 0x7F) if not chr(b).isalnum()])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict = {}


def _powers(n: int, salt: int):
    """Powers of an odd number and of its inverse modulo 2**64, and 256 random values."""
    t = _tables.get(salt)
    if t is None or len(t[0]) < n:
        n = max(n, SEGMENT + 1)
        rng = np.random.Generator(np.random.PCG64(977 + salt))
        values = rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
        base = (_MUL + 2 * 0x632BE59BD9B4E019 * salt) % 2**64 | 1
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _tables[salt] = t = (*both, values)
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, offs: np.ndarray, classes: np.ndarray, salts=(0,), lower: bool = False):
    """Words of all rows: (start, end, row, hash for each salt), in order; bytes of one class make a word.

    Equal words have equal hashes; two different ones agree with a chance of about 2**-64 for each salt.
    """
    parts = []
    if lower:
        classes = np.where((np.arange(256) > 64) & (np.arange(256) < 91), classes[LOWER], classes)
    at, n = 0, len(buf)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    while at < n:
        to = min(n, at + SEGMENT)
        while to < n:  # cut where no word is running
            tail = np.flatnonzero((classes[buf[at:to]] == 0) | first[at + 1 : to + 1])
            if len(tail):
                to = at + int(tail[-1]) + 1
                break
            to = min(n, to + SEGMENT)
        b = LOWER[buf[at:to]] if lower else buf[at:to]
        c = classes[b]
        edge = np.empty(len(b) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(c[1:], c[:-1], out=edge[1:-1])
        edge |= first[at : to + 1]
        word = c > 0
        s, e = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:]) + 1
        hs = []
        for salt in salts:
            pw, inv, values = _powers(len(b) + 1, salt)
            run = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(values[b] * pw[: len(b)], out=run[1:])
            hs.append(mix((run[e] - run[s]) * inv[s] + (e - s).astype(np.uint64)))
        parts.append((s + at, e + at, *hs))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return (none, none, none, *(none.astype(np.uint64) for _ in salts))
    s, e, *hs = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    return (s, e, np.searchsorted(offs, s, "right") - 1, *hs)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (also those across rows), by doubling: len(h) - k + 1 values."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width, power = None, 0, _MUL
    part, size = h, 1
    while True:
        if k & size:
            out = part if out is None else out[: len(out) - size] * np.uint64(power) + part[width : width + len(out) - size]
            width += size
        if size * 2 > k:
            return mix(out[: len(h) - k + 1])
        part = part[:-size] * np.uint64(power) + part[size:]
        size *= 2
        power = power * power % 2**64


def row_starts(row: np.ndarray, n_rows: int) -> np.ndarray:
    """First position of each row in a sorted array of row numbers, n_rows + 1 values."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def batches(frames, limit: int = 4_000_000, text: str = "text"):
    """Record batches cut so that each holds about `limit` bytes of text at most (one row at least)."""
    for b in frames:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        _, offs = text_bytes(col)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
    release()
