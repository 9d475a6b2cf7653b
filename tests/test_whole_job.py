"""Cases in which an operator has to do the whole job, against plain brute force."""

import numpy as np
from pyspark.sql import functions as F

from tandem.operators import retrieve


def scan(sims, least):
    """Brute force: the scan in id order."""
    root = {}
    for i in range(len(sims)):
        if i not in root:
            root[i] = i
            root |= {j: i for j in range(i + 1, len(sims)) if j not in root and sims[i, j] >= least}
    return root


def test_duplicates_cover_all_items(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 6)).round(3)
    x[2] = x[1]  # two equal vectors, neither id divisible by 20
    x[100:200] = x[100]  # a group of a third of all rows
    x[250] = 0
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "item_id long, vec array<double>")
    sims = np.round(unit @ unit.T, 6)
    near = {(r["query_id"], r["target_id"]) for r in retrieve.similar_pairs(df, 0.9, block_rows=64).collect()}
    assert near == {(a, b) for a in range(300) for b in range(a + 1, 300) if sims[a, b] >= 0.9}
    got = {r["item_id"]: r["representative"] for r in retrieve.duplicates_of_vectors(df, 0.9, str(tmp_path / "x")).collect()}
    assert got == scan(sims, 0.9)
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    from tandem.plans.queries_relations import find_duplicates

    named = {r["item_id"]: r["representative"] for r in find_duplicates(spark, str(tmp_path)).collect()}
    assert named[1] == named[2]
    assert len({named[i] for i in range(100, 200)}) == 1


def test_duplicates_end_when_no_item_is_open(spark, tmp_path):
    chain = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(2, 9), (8, 9)], "a long, b long")
    got = retrieve.find_duplicates(spark.range(10).withColumnRenamed("id", "item_id"), chain, str(tmp_path / "y"))
    assert {r["item_id"]: r["representative"] for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 2}
