"""Token-id output: flat unsigned integer files with 64-bit document offsets, read back as memory maps.

`write_tokens` sorts the documents by id over range partitions; each task writes three flat little-endian files
(token ids, 64-bit offsets of its documents, 64-bit document ids) under a temporary name and renames them when they
are complete, so that a repeated or speculative task leaves whole files only.  The driver holds one row per
partition; a partition's base is the prefix sum of the token counts before it.  `read_tokens` maps the files and
returns one row per document.

Null text counts as empty, so such a document holds the end id only; a null doc_id sorts first.  Rows that share a
doc_id are all written, in the order of their texts.  An empty table gives a manifest with no parts.  Other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm._common import batches, scratch
from tandem.llm._tokens import encoder

NO_ID = -(2**63)


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
    return fs, path


def _array(fs, path: str, dtype) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, byte_level: bool = True, end_id: int = 2) -> dict:
    """Write `docs` (doc_id, text) to the folder `out` and return the manifest, also written there as JSON."""
    spark = docs.sparkSession
    fs, root = _open(out)
    fs.create_dir(root, recursive=True)

    def write(frames):
        enc = encoder(tokenizer, byte_level)
        dtype = np.dtype("<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        fs, root = _open(out)
        part, tmp = f"{TaskContext.get().partitionId():06d}", uuid.uuid4().hex
        end, offsets, ids, n, f = np.array([end_id], "<u4").tobytes(), [0], [], 0, None
        for b in batches(frames):
            if f is None:
                f = fs.open_output_stream(f"{root}/{tmp}.tokens")
            done = []
            for x in enc.encode(b.column("text").fill_null("").to_pylist()):
                done.append(x + end)
                n += len(x) // 4 + 1
                offsets.append(n)
            ids.append(b.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy())
            f.write(np.frombuffer(b"".join(done), "<u4").astype(dtype).tobytes())
        enc.trim()
        if f is None:
            return
        f.close()
        for name, x in (("offsets", np.array(offsets, "<i8")), ("docs", np.concatenate(ids).astype("<i8"))):
            with fs.open_output_stream(f"{root}/{tmp}.{name}") as g:
                g.write(x.tobytes())
        for name in ("tokens", "offsets", "docs"):
            fs.move(f"{root}/{tmp}.{name}", f"{root}/part-{part}.{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "dtype": [dtype.str], "n_docs": [len(offsets) - 1], "n_tokens": [n]})

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(write, "part string, dtype string, n_docs long, n_tokens long")
        .collect()  # one row per partition
    )
    parts, base, first = [], 0, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        parts.append({"part": r["part"], "base": base, "first_doc": first, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        base, first = base + r["n_tokens"], first + r["n_docs"]
    manifest = {"dtype": rows[0]["dtype"] if rows else "<u4", "end_id": end_id, "n_tokens": base, "n_docs": first, "parts": parts}
    with fs.open_output_stream(posixpath.join(root, "manifest.json")) as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(out: str) -> dict:
    fs, root = _open(out)
    with fs.open_input_stream(posixpath.join(root, "manifest.json")) as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False, docs_per_task: int = 50_000) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and the ids if asked for."""
    m = read_manifest(out)
    dtype = m["dtype"]

    def read(frames):
        fs, root = _open(out)
        for b in frames:
            for r in b.to_pylist():
                tokens = _array(fs, f"{root}/part-{r['part']}.tokens", dtype)
                offsets = _array(fs, f"{root}/part-{r['part']}.offsets", "<i8")
                ids = _array(fs, f"{root}/part-{r['part']}.docs", "<i8")
                for at in range(r["lo"], r["hi"], 1000):
                    to = min(at + 1000, r["hi"])
                    own = [tokens[offsets[i] : offsets[i + 1]].astype("<u4") for i in range(at, to)]
                    cols = {
                        "doc_id": pa.array(ids[at:to], mask=np.asarray(ids[at:to] == NO_ID)),
                        "start": pa.array(offsets[at:to] + r["base"]),
                        "n_tokens": pa.array(np.diff(offsets[at : to + 1])),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    tasks = [(p["part"], p["base"], lo, min(lo + docs_per_task, p["n_docs"])) for p in m["parts"] for lo in range(0, p["n_docs"], docs_per_task)]
    frame = spark.createDataFrame(tasks, "part string, base long, lo long, hi long")
    return frame.repartition(max(1, len(tasks)), "part", "lo").mapInArrow(read, schema)


def token_file_table(docs: DataFrame, tokenizer: str, byte_level: bool = True, end_id: int = 2) -> DataFrame:
    """Write `docs` to a new folder of the shared directory and read the documents back."""
    out = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, out, tokenizer, byte_level, end_id)
    return read_tokens(docs.sparkSession, out)
