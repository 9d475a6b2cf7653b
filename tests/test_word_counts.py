"""Words counted by document, weights and pooled vectors without a row for each token."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import bow, embed, tokens, word_counts
from tandem.plans import tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_equal_counter(spark):
    rows = [(1, "a b  a"), (2, None), (3, ""), (1, "a ž"), (None, "x y"), (4, "z")]
    lines = spark.createDataFrame(rows, "item_id long, line string").repartition(3)
    want = Counter((i, w) for i, t in rows if t is not None for w in t.split(" "))
    for size in (1, 65_536):
        got = [tuple(r) for r in word_counts.counted(lines, rows=size).collect()]
        assert dict(((i, w), n) for i, w, n in got) == want and len(got) == len(want)
    whole = word_counts.counted(lines.where("item_id > 1"), together=False, whole=True).collect()
    assert sorted((r["item_id"], "-" if r["feature"] is None else r["feature"], r["value"]) for r in whole) == [(2, "-", 0), (3, "", 1), (3, "-", 0), (4, "-", 0), (4, "z", 1)]


def test_cells_are_those_of_tokens(spark, tmp_path):
    docs = [(1, "A.b, C\nc  a,b\n\n.,."), (2, None), (3, ""), (4, "Größe ΟΔΟΣ.\nΟΔΟΣ İ\tx"), (1, "c")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cells = tables.cells(spark, str(tmp_path))
    assert "Generate" not in plan(cells)  # no row for each token
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(cells) == key(bow.bow(tables.tokens(spark, str(tmp_path))))


def test_kept_cells_are_those_of_kept_tokens(spark):
    rng = np.random.default_rng(5)
    rows = [(d, 0, i, f"w{int(w)}") for d in range(30) for i, w in enumerate(rng.zipf(1.5, 40) % 50)] + [(d, 1, 0, "all") for d in range(30)]
    toks = spark.createDataFrame(rows, "doc_id long, sent_no int, tok_no int, token string")
    cells = bow.bow(toks)
    weights = bow.tfidf(cells, 30).select(F.col("item_id").alias("doc_id"), F.col("feature").alias("token"), F.round("value", 6).alias("weight"))
    for add in (0.05, 0.2):
        want = {tuple(r) for r in bow.bow(tokens.tfidf_token_filter(toks, weights, add)).collect()}
        assert want and {tuple(r) for r in bow.tfidf_kept(cells, 30, add).collect()} == want


@pytest.mark.parametrize("op", ["max", "sum", "avg"])
@pytest.mark.parametrize("group_bytes", [40, 1 << 20])
def test_pooling_by_id_equals_numpy(spark, op, group_bytes):
    """Words share vectors; 40 bytes: each vector is a group of its own."""
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=5) for i in range(12)}
    ids = {f"w{i}": int(rng.integers(0, 9)) for i in range(40)}
    items = {i: sorted({"all", *(f"w{j}" for j in rng.integers(0, 60, rng.integers(0, 9)))}) for i in range(300)}  # w40 to w59 and all are unknown
    words = spark.createDataFrame([(i, w) for i, ws in items.items() for w in ws], "item_id long, feature string").repartition(7)
    known = spark.createDataFrame(list(ids.items()), "word string, vec_id long")
    held = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id int, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        from tandem.operators.embed_sums import pooled_by_id

        got = pooled_by_id(words.withColumnRenamed("feature", "word"), known, held, 5, op, group_bytes).collect()
        assert {r["item_id"] for r in embed.pool_embeddings(words, known.limit(0), 5, op, vectors=held).where("vec[0] = 0").collect()} == set(items)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fold = {"max": np.max, "sum": np.sum, "avg": np.mean}[op]
    assert len(got) == 300
    for r in got:
        want = fold([vectors[ids[w]] if w in ids else np.zeros(5) for w in items[r["item_id"]]], axis=0)
        assert r["vec"] == pytest.approx(want.tolist(), abs=1e-12)
    assert embed.pool_embeddings(words.limit(0), known, 5, op, vectors=held).count() == 0
