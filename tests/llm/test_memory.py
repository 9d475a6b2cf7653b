"""Workers go on to other tasks, so what a task has freed must not stay with the process."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import numpy as np, psutil
import tandem.llm._common
del (x := [np.ones(31 << 17)])[:]  # glibc would from now on keep blocks of this size
blocks = [(np.ones(1 << 20), np.ones(1 << 12)) for _ in range(30)]
small = [b for _, b in blocks]
del blocks
print(psutil.Process().memory_info().rss >> 20)
"""


def test_freed_blocks_go_back():
    out = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, check=True, timeout=60)
    base = subprocess.run([sys.executable, "-c", CODE.replace("range(30)", "range(1)")], cwd=ROOT, capture_output=True, text=True, check=True, timeout=60)
    assert int(out.stdout.split()[-1]) - int(base.stdout.split()[-1]) < 60  # of 240


FAULTS = """
import resource
import numpy as np
import tandem.llm._common
for _ in range(3):
    x = [np.ones(60_000) for _ in range(4)]
    del x
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(100):
    x = [np.ones(60_000) for _ in range(4)]
    del x
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""


def test_small_arrays_are_not_fetched_again():
    out = subprocess.run([sys.executable, "-c", FAULTS], cwd=ROOT, capture_output=True, text=True, check=True, timeout=60)
    assert int(out.stdout.split()[-1]) < 5_000  # of 47,000 pages


def test_a_shard_is_merged_without_a_table_of_its_cells():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tandem.llm import substring_dedup as S

    parts = [(np.array([1, 5, 9]), np.array([0, 1, 0]), np.array([0, 0, 1])), (np.array([2, 5]), np.array([2, 2]), np.array([0, 0]))]
    table = pa.table({"shard": [3, 3], "n": [3, 2], "cells": pa.array([S._packed(*x) for x in parts], pa.binary())})
    tracemalloc.start()
    out = S._merge(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(r["chunk"], r["part"], tuple(S._unpacked(r["data"], r["n"]))) for r in out} == {(0, 3, (9,)), (1, 3, (5,)), (2, 3, (5,))}
    assert peak < 16 << 20


def test_quality_sends_texts_to_python_in_small_batches_only(spark, tmp_path, monkeypatch):
    """Who writes the result sends no text to Python; the counts are made from batches of at most ARROW_ROWS."""
    import corpus_pipeline
    from tandem.llm import importance
    from tandem.llm._common import ARROW_ROWS, batches

    def counted(frames, *args):
        def small(b):
            assert b.num_rows <= ARROW_ROWS
            return b

        yield from batches(map(small, frames), *args)

    monkeypatch.setattr(importance, "batches", counted)
    rows = [(i, f"good words {i // 4}" if i % 3 else "x 1 " * (1 + i % 7)) for i in range(4_500)] * 2
    rows += [(7, None), (None, None), (None, "x 1 "), (None, "good words 1"), (None, "good words 1")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, _hash string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()
    selected = importance.select(docs, labels, keep=["doc_id", "text"]).where("selected")
    key = lambda r: str((r["doc_id"], r["text"]))
    with importance.small_batches(spark):
        want = sorted(map(key, selected.collect()))
    assert sorted(map(key, out.collect())) == want and 0 < len(want) < len(rows)
