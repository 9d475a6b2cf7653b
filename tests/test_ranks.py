"""Chosen places of rankings against full rankings, with many ties."""

import numpy as np
from pyspark.sql import functions as F

from tandem.operators import ranks, retrieve


def test_places_equal_the_full_ranking(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (700, 4)).astype(float)  # few directions: long ties
    x[300:500] = x[300]
    x[5] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, vec array<double>").repartition(5)
    queries = df.where("item_id % 50 = 0")
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    sims = np.round(unit @ unit.T, 3) + 0.0
    full = {q: sorted(range(700), key=lambda j: (-sims[q, j], j)) for q in range(0, 700, 50)}
    wanted = [(q, r) for q in full for r in (1, 2, 150, 151, 350, 700)]
    got = ranks.places(queries, df, spark.createDataFrame(wanted, "query_id long, rank long"), 3, block_rows=64)
    assert {(r["query_id"], r["rank"]): (r["target_id"], r["sim"]) for r in got.collect()} == {(q, r): (full[q][r - 1], sims[q, full[q][r - 1]]) for q, r in wanted}
    assert got.count() == len(wanted)
    counts = ranks.value_counts(queries, df, 3, block_rows=64)
    assert counts.agg(F.sum("n")).first()[0] == 14 * 700
    bins = retrieve.similarity_distribution(queries, df, digits=3).where("query_id = 50").agg(F.sum("n")).first()[0]
    assert bins == 700


def test_fewer_items_than_places(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "item_id long, vec array<double>")
    assert sorted(r["rank"] for r in retrieve.similarity_buckets(df.where("item_id = 0"), df, 5, 4).collect()) == [1, 2, 3, 4]
    got = retrieve.annotation_candidates(df, df, p_duplicates=0).groupBy("query_id").count().collect()
    assert all(r["count"] in (3, 4) for r in got)
    assert retrieve.annotation_candidates(df.limit(0), df).count() == 0


def test_counts_stay_in_the_task_that_holds_the_queries(spark, monkeypatch):
    """No rows of counts are shuffled or written, only the wanted places; each query is in one group."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, vec array<double>").repartition(4)
    queries, names = df.where("item_id % 10 = 0"), []
    keep = ranks.written
    monkeypatch.setattr(ranks, "written", lambda t, name: names.append((name, t.count())) or keep(t, name))
    got = retrieve.similarity_buckets(queries, df, 3, 2, digits=4)
    assert got.count() == 40 * 5 and names == [("wanted-places", 40 * 5)]
    bins = retrieve.similarity_distribution(queries, df, digits=4)
    plan = bins._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and bins.groupBy("query_id", "bin").count().where("count > 1").isEmpty()


def test_top_k_of_copies_is_bounded(spark):
    """All items are copies: each task returns k of them for a query, not all."""
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "item_id long, vec array<double>").repartition(3)
    got = retrieve.similarity_topk_dense(df.where("item_id % 50 = 0"), df, 3, digits=4).collect()
    assert {(r["query_id"], r["rank"]): r["target_id"] for r in got} == {(q, k + 1): k for q in range(0, 200, 50) for k in range(3)}
