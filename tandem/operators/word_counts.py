"""Words counted where their text lies: a row for each distinct word of an item, none for each token."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _count(whole: bool, rows: int):
    def count(frames):
        ids, sizes, words, counts = [], [], [], []
        now, own, kind = None, None, None

        def close():
            ids.append(now)
            sizes.append(len(own) + whole)
            words.extend(own)
            counts.extend(own.values())
            if whole:
                words.append(None)
                counts.append(0)

        def emit():
            item = pa.array(ids, kind).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
            batch = pa.RecordBatch.from_arrays([item, pa.array(words, pa.binary()).view(pa.string()), pa.array(np.array(counts, float))], names=["item_id", "feature", "value"])
            for x in (ids, sizes, words, counts):
                x.clear()
            return batch

        for b in frames:
            kind = b.column(0).type
            for item, line in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                if own is None or item != now:
                    if own is not None:
                        close()
                        if len(words) >= rows:
                            yield emit()
                    now, own = item, Counter()
                line = line.as_py()
                if line is not None:
                    own.update(line.split(b" "))
        if own is not None:
            close()
            yield emit()

    return count


def counted(lines: DataFrame, together: bool = True, whole: bool = False, rows: int = 65_536) -> DataFrame:
    """item_id, feature and value, its count, of the words of (item_id, line), between which stands one blank; null lines have none.

    Rows of one item are brought together, unless no item has two or they already stand so. whole: each item also gets a row of no word, value 0.
    An item's distinct words must fit its task's memory.
    """
    kind = lines.schema["item_id"].dataType.simpleString()
    lines = lines.select("item_id", "line")
    ordered = lines.repartition("item_id").sortWithinPartitions("item_id") if together else lines
    return ordered.mapInArrow(_count(whole, rows), f"item_id {kind}, feature string, value double")
