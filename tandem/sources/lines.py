"""Lines of text files with their numbers, read in blocks by many tasks: a segmented prefix sum over the blocks.

Spark cuts files that can be split into blocks; a block's lines are those that begin after its first line end.  Each
task counts along its own blocks, which gives a line's numbers within its block.  One small table has a row for each
block with its sums; running sums over that table give the numbers at the start of each block.  Both are added up by
a join on (file, block).  Files that can't be split (gzip) are one block, read line by line; no file is held whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.operators._shared import written

#: Blocks that are broadcast at most, as counted; more are joined by a shuffle.
BROADCAST_BLOCKS = 100_000


def _blocks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))


def _blank():
    return F.trim("value") == ""


def _count(frames):
    """For each line: its number, the blank lines before it, and the others since the last blank one, all within its block."""
    at, state = None, (0, 0, 0)
    for b in frames:
        if not b.num_rows:
            continue
        files, starts, blank = b.column(0), b.column(1), b.column(3).to_numpy(zero_copy_only=False)
        cut = np.ones(b.num_rows, bool)  # a block begins here
        cut[1:] = np.diff(starts.to_numpy()) != 0
        cut[1:] |= pc.not_equal(files.slice(1), files.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        own = (files[0].as_py(), starts[0].as_py())
        first = np.flatnonzero(cut)
        if own == at:
            cut[0] = False
            first = np.flatnonzero(cut)
        else:
            state = (0, 0, 0)
        n, i = b.num_rows, np.arange(b.num_rows)
        segment = np.cumsum(cut)  # 0: goes on from the batch before
        began = np.r_[0, first][segment]
        going = segment == 0
        line = i - began + np.where(going, state[0], 0)
        blanks = np.r_[0, np.cumsum(blank)]
        before = blanks[:-1] - blanks[began] + np.where(going, state[1], 0)
        last = np.maximum.accumulate(np.where(blank, i, -1))  # the last blank line up to here
        last = np.r_[-1, last[:-1]]
        since = np.where(last >= began, i - last - 1, i - began + np.where(going, state[2], 0))
        end = n - 1
        state = (int(line[end]) + 1, int(before[end] + blank[end]), 0 if blank[end] else int(since[end]) + 1)
        at = (files[end].as_py(), starts[end].as_py())
        kinds = [pa.array(x.astype(np.int64)) for x in (line, before, since)]
        yield pa.RecordBatch.from_arrays([files, starts, b.column(2), b.column(3), *kinds], names=["file", "block", "value", "blank", "line", "before", "since"])


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, value, blank, line_no (within the file), line_all (over all files by name), blanks (blank lines before it in the file) and since (others since the last blank one)."""
    read = _blocks(spark, paths)
    at = F.monotonically_increasing_id()  # consecutive within a block
    marks = read.select("file", "block", at.alias("at"), _blank().alias("blank"))
    sums = marks.groupBy("file", "block").agg(
        F.count("*").alias("lines"), F.count_if("blank").alias("blanks"), (F.max("at") - F.coalesce(F.max(F.when(F.col("blank"), F.col("at"))), F.min("at") - 1)).alias("tail")
    )
    sums = written(sums, "line-blocks")  # a row for each block
    files = sums.groupBy("file").agg(F.sum("lines").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lines_before"))
    run = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # what is left open since the last blank line: the tails of the blocks from the last one that has a blank line
    passed = F.coalesce(F.sum("blanks").over(run), F.lit(0))
    all_tails = F.coalesce(F.sum("tail").over(run), F.lit(0))
    before_last = F.coalesce(F.max(F.when(F.col("blanks") > 0, F.col("_tails"))).over(run), F.lit(0))
    starts = sums.withColumn("_tails", all_tails).select("file", "block", F.coalesce(F.sum("lines").over(run), F.lit(0)).alias("_line"), passed.alias("_blanks"), (F.col("_tails") - before_last).alias("_open"))
    starts = starts.join(files, "file")
    near = F.broadcast(starts) if sums.count() <= BROADCAST_BLOCKS else starts
    counted = read.select("file", "block", "value", _blank().alias("blank")).mapInArrow(_count, "file string, block long, value string, blank boolean, line long, before long, since long")
    line_no = F.col("line") + F.col("_line")
    since = F.col("since") + F.when(F.col("before") == 0, F.col("_open")).otherwise(0)
    return counted.join(near, ["file", "block"]).select(
        "file", "value", "blank", line_no.alias("line_no"), (line_no + F.col("_lines_before")).alias("line_all"), (F.col("before") + F.col("_blanks")).alias("blanks"), since.alias("since")
    )
