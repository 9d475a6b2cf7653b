"""Pooling of whole vectors against numpy: unknown words, a word of every item, many chunks and batches."""

import numpy as np
import pytest

from tandem.operators import embed, embed_sums


@pytest.mark.parametrize("op", ["max", "sum", "avg"])
def test_pooling_equals_numpy(spark, op):
    rng = np.random.default_rng(3)
    vectors = {f"w{i}": rng.normal(size=5) for i in range(40)}
    items = {i: sorted({"all", *(f"w{j}" for j in rng.integers(0, 60, rng.integers(0, 9)))}) for i in range(900)}  # w40 to w59 are unknown
    vectors["all"] = rng.normal(size=5)
    items[900] = ["unknown"]
    words = spark.createDataFrame([(i, w) for i, ws in items.items() for w in ws], "item_id long, word string").repartition(7)
    known = spark.createDataFrame([(w, v.tolist()) for w, v in vectors.items()], "word string, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # items go on over several batches
    try:
        got = {r["item_id"]: r["vec"] for r in embed_sums.pooled(words, known, 5, op, chunk_items=50).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fold = {"max": np.max, "sum": np.sum, "avg": np.mean}[op]
    assert len(got) == 901
    for i, ws in items.items():
        assert got[i] == pytest.approx(fold([vectors.get(w, np.zeros(5)) for w in ws], axis=0).tolist(), abs=1e-12)


def test_counts_and_senses_are_ignored(spark):
    cells = spark.createDataFrame([("a", "Bank-1", 3.0), ("a", "bank-2", 1.0), ("b", "x", 1.0)], "item_id string, feature string, value double")
    known = spark.createDataFrame([("bank", [2.0, -4.0])], "word string, vec array<double>")
    got = {r["item_id"]: r["vec"] for r in embed.pool_embeddings(cells, known, 2, "avg", lowercase=True, strip_sense=True).collect()}
    assert got == {"a": [2.0, -4.0], "b": [0.0, 0.0]}
    assert embed.pool_embeddings(cells.limit(0), known, 2).count() == 0
