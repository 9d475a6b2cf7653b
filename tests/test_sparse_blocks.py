"""Products of groups against a plain join, also where signs cancel, cells repeat and most features are rare."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import link, retrieve, sparse_blocks, sparse_index


def rows(rng, n, signs):
    out = []
    for i in range(n):
        own = rng.sample(range(40), rng.randrange(1, 9)) + [100 + rng.randrange(200) for _ in range(3)]
        out += [(i, f"f{f}", float(rng.choice([1, 2, 3]) * rng.choice(signs))) for f in own]  # some features twice
    return out


def plain(spark, cells):
    q = cells.where("item_id % 5 = 0").select(F.col("item_id").alias("q"), "feature", F.col("value").alias("x"))
    d = cells.select(F.col("item_id").alias("t"), "feature", "value")
    return {(r["q"], r["t"]): r["s"] for r in q.join(d, "feature").groupBy("q", "t").agg(F.sum(F.col("x") * F.col("value")).alias("s")).collect()}


@pytest.mark.parametrize("signs", [[1], [1, -1]])
def test_products_equal_the_join(spark, monkeypatch, signs):
    monkeypatch.setattr(sparse_blocks, "GROUP_CELLS", 150)
    cells = spark.createDataFrame(rows(random.Random(3), 120, signs), "item_id long, feature string, value double").repartition(3)
    bag = lambda df: sparse_blocks.bags(df, "item_id", "feature", F.col("value"))
    got = {(r["query_id"], r["target_id"]): r["sim"] for r in sparse_blocks.products(bag(cells.where("item_id % 5 = 0")), bag(cells)).collect()}
    assert got == plain(spark, cells)


def test_frequent_features_go_by_groups(spark, monkeypatch):
    monkeypatch.setattr(sparse_index, "MANY", 0)
    called = []
    products = sparse_blocks.products
    monkeypatch.setattr(sparse_blocks, "products", lambda *a: called.append(1) or products(*a))
    cells = retrieve.normalized(spark.createDataFrame(rows(random.Random(4), 90, [1]), "item_id long, feature string, value double").groupBy("item_id", "feature").agg(F.sum("value").alias("value")))
    cells = cells.unionByName(cells.select("item_id", F.lit("all").alias("feature"), F.lit(0.5).alias("value")).distinct())
    got = retrieve.similarity_topk_sparse(cells.where("item_id % 5 = 0"), cells, 4, digits=3).collect()
    want = {}
    for (q, t), s in plain(spark, cells).items():
        want.setdefault(q, []).append((-round(s, 3), t))
    assert called and {(r["query_id"], r["rank"]): (-r["sim"], r["target_id"]) for r in got} == {(q, i + 1): x for q, v in want.items() for i, x in enumerate(sorted(v)[:4])}


def test_votes_make_no_row_for_each_shared_word(spark):
    """The plan joins no words with images; scores are those of the join."""
    cells = spark.createDataFrame(rows(random.Random(5), 60, [1]), "item_id long, feature string, value double").groupBy("item_id", "feature").agg(F.sum("value").alias("value"))
    targets = cells.select(F.col("feature").alias("word"), F.concat(F.lit("i"), F.col("item_id") % 9).alias("image_name")).distinct()
    for mode, vote in (("hard", F.lit(1.0)), ("soft", F.col("value"))):
        found = link.map_words_to_targets(cells, targets, mode)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = cells.join(targets, F.col("feature") == F.col("word")).groupBy("item_id", "image_name").agg(F.sum(vote).alias("score"))
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}
