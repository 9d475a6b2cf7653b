"""Vector code compression: product codes whose codebooks are trained by Lloyd's rounds over resident members.

A vector becomes integers, floor(scale * x), cut into `parts` equal consecutive parts (the last ones filled up with
zeros where the length doesn't divide).  Each position has its own codebook of up to `k` entries.

Training keeps every part with the owner of its entry.  An owner is a row of a table that is bucketed by (position,
entry, salt): the members it holds and their sums.  In a round

- owners update: the sums they hold are added by (position, entry), which reads no member; entries become floor(sum /
  count), unused ones stay;
- each owner compares its members with the new codebook where they lie.  What stays is not sent; for what changes its
  entry a row says which places leave, and the leaving parts themselves are the owner's only outgoing rows;
- those rows alone are shuffled, to the buckets of their new owners, which take them in: a join of the bucketed table
  with the mail, with no exchange on the table's side.

Salts split an entry that many parts share: an entry gets one owner for each `owner_rows` members it has grown to, and
arriving batches (of `owner_rows` parts at most) are dealt to its owners.  Residents never move to another salt.
Training ends early when no part changes its entry, as nothing would change any more.  Codebooks (parts x k entries)
are held by the driver and sent with the tasks; they do not grow with the input.  Every table is written to the shared
folder before it is read, so a lost executor costs its tasks only.

Rows whose vector is null or empty or holds null or non-finite components are dropped, and so are vectors of another
length than that of the smallest id's.  Repeated ids and rows count as often as they occur; the first codebook takes
the k smallest by id (null last), then by vector.  Fewer than k rows give fewer entries; an empty table gives no rows.
Integers beyond +-2**27 are held to that.  Only id, vector and label are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm._common import bucketed, temporary, written
from tandem.llm._vectors import digest, integers, nearest, rows_of

#: What an owner's row has, and what is sent: `at` are places that leave, `members` parts that arrive.
_KEYS = ["position", "entry", "salt"]
_OWNER = "position int, entry int, salt int, n long, members array<int>, sums array<long>"
_MAIL = "position int, entry int, salt int, piece long, n long, at array<int>, members array<int>"


def _padded(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    """Rows of components as (rows, parts, width)."""
    out = np.zeros((len(x), parts * width), np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def _mail(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"position": pa.int32(), "entry": pa.int32(), "salt": pa.int32(), "piece": pa.int64(), "n": pa.int64(), "at": pa.list_(pa.int32()), "members": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(kinds))


def _letters(position: int, members: np.ndarray, to: np.ndarray, owner_rows: int):
    """Parts by the entry they go to, in letters of at most `owner_rows`; `piece` deals them to salts."""
    order = np.argsort(to, kind="stable")
    to, members = to[order], members[order].astype(np.int32)
    bounds = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for at in range(a, b, owner_rows):
            own = members[at : min(b, at + owner_rows)]
            yield position, int(to[a]), None, zlib.crc32(own.tobytes()) + at, len(own), None, own.ravel()


def _first(codebooks: np.ndarray, owner_rows: int):
    parts, _, width = codebooks.shape

    def send(frames):
        for b in frames:
            if b.num_rows:
                x = rows_of(b.column(0), len(b.column(0)[0]))
                x = _padded(x, parts, width)
                for p in range(parts):
                    yield _mail(list(_letters(p, x[:, p], nearest(x[:, p], codebooks[p])[0], owner_rows)))

    return send


def _leaving(codebooks: np.ndarray, owner_rows: int):
    width = codebooks.shape[2]

    def send(frames):
        for b in frames:
            rows = []
            for p, entry, salt, members in zip(*(b.column(c) for c in (*_KEYS, "members")), strict=True):
                p, entry, salt = p.as_py(), entry.as_py(), salt.as_py()
                x = members.values.to_numpy().reshape(-1, width)
                to = nearest(x, codebooks[p])[0]
                gone = np.flatnonzero(to != entry)
                if len(gone):
                    rows.append((p, entry, salt, 0, -len(gone), gone.astype(np.int32), None))
                    rows.extend(_letters(p, x[gone], to[gone], owner_rows))
            if rows:
                yield _mail(rows)

    return send


def _settle(width: int):
    """Owners after the mail: what left is cut out, what arrived is added."""

    def merge(frames):
        for b in frames:
            rows: dict[str, list] = {c: [] for c in (*_KEYS, "n", "members", "sums")}
            for i in range(b.num_rows):
                get = lambda c, i=i: b.column(c)[i]
                old = get("members").values
                x = (np.zeros(0, np.int32) if old is None else old.to_numpy()).reshape(-1, width)
                if (at := get("at").values) is not None:
                    x = np.delete(x, at.to_numpy(), axis=0)
                if (new := get("arrived").values) is not None:
                    x = np.concatenate([x, new.to_numpy().reshape(-1, width)])
                if len(x):
                    for c in _KEYS:
                        rows[c].append(get(c).as_py())
                    rows["n"].append(len(x))
                    rows["members"].append(x.ravel())
                    rows["sums"].append(x.sum(0, dtype=np.int64))
            if rows["n"]:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return merge


def _delivered(mail: DataFrame, salts: np.ndarray, buckets: int) -> DataFrame:
    """One row for each owner that gets mail: the places that leave it, the parts that arrive."""
    k = salts.shape[1]
    owners = F.get(F.lit(salts.ravel().tolist()), F.col("position") * k + F.col("entry"))
    salt = F.coalesce("salt", F.pmod(F.xxhash64("piece"), owners).cast("int"))
    sent = mail.withColumn("salt", salt).repartition(buckets, *_KEYS).groupBy(*_KEYS)
    return sent.agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("members")).alias("arrived"))


def _settled(owners: DataFrame, delivered: DataFrame, width: int) -> DataFrame:
    """The owners' rows after the mail; only the mail is shuffled."""
    return owners.select(*_KEYS, "members").join(delivered, _KEYS, "full").mapInArrow(_settle(width), _OWNER)


def fit(vectors: DataFrame, k: int = 256, parts: int = 4, rounds: int = 4, owner_rows: int = 2048, task_bytes: int = 64 << 20) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of rows (id, v); None if there are no rows."""
    spark = vectors.sparkSession
    seeds = [r["v"] for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(k).collect()]
    if not seeds:
        return None
    width = -(-len(seeds[0]) // parts)
    books = _padded(np.array(seeds, np.int64), parts, width).transpose(1, 0, 2).copy()
    k = books.shape[1]
    salts, sizes = np.ones((parts, k), np.int64), np.zeros((parts, k), np.int64)
    with temporary(spark):
        mail, owners = vectors.select("v").mapInArrow(_first(books, owner_rows), _MAIL), None
        for i in range(rounds):
            mail = written(mail, "mail")
            counts = mail.groupBy("position", "entry").agg(F.sum("n").alias("n")).collect()  # parts * k rows at most
            if not counts:
                break  # nothing moves any more
            for r in counts:
                sizes[r["position"], r["entry"]] += r["n"]
            salts = np.maximum(salts, -(-sizes // owner_rows))
            if owners is None:
                buckets = max(spark.sparkContext.defaultParallelism, -(-int(sizes.sum()) * width * 4 // task_bytes))
                none = spark.createDataFrame([], _OWNER)
                owners = _settled(none, _delivered(mail, salts, buckets), width)
            else:
                owners = _settled(owners, _delivered(mail, salts, buckets), width)
            owners = bucketed(owners, "owners", buckets, _KEYS)
            held = owners.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
            for r in held.collect():  # parts * k rows at most
                books[r["position"], r["entry"]] = np.array([r[f"s{j}"] for j in range(width)], np.int64) // r["n"]
            if i < rounds - 1:
                mail = owners.select(*_KEYS, "members").mapInArrow(_leaving(books, owner_rows), _MAIL)
    return books


def encode(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits for each part) and error of rows (id, label, v)."""
    parts, _, width = codebooks.shape

    def code(frames):
        for b in frames:
            if b.num_rows:
                v = b.column(b.schema.get_field_index("v"))
                x = _padded(rows_of(v, len(v[0])), parts, width)
                found = [nearest(x[:, p], codebooks[p]) for p in range(parts)]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in codes]), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    schema = f"id {vectors.schema['id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    return vectors.select("id", "label", "v").mapInArrow(code, schema)


def compress(
    vectors: DataFrame, k: int = 256, parts: int = 4, scale: int = 1024, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", broadcast_rows: int = 1_000_000
) -> DataFrame:
    """id_col, code, error, label_error (the errors' sum over the rows of a label, nulls together; null beyond 64 bits) and codebooks_sha256.

    k is 256 at most, as an index has two hex digits.  Labels meet their sums by a broadcast if at most
    `broadcast_rows` labels were counted, else by a join whose hot labels Spark splits.
    """
    if not 0 < k <= 256:
        raise ValueError("k has to be 1 to 256")
    kept = integers(vectors, scale, vec_col, F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    kept = kept.where(F.size("v") == (first["n"] if first else 0))
    books = fit(kept, k, parts, rounds)
    if books is None:
        return kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    codes = written(encode(kept, books), "codes")
    sums = written(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    near = F.broadcast(sums) if sums.count() <= broadcast_rows else sums
    out = codes.join(near, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
