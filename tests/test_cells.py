"""Counted words are not shuffled, and three representations come from one table."""

from pyspark.sql import functions as F

from tandem.operators import bow
from tandem.plans import tables


def test_counted_words_stay_with_their_document(spark, tmp_path):
    docs = [(1, "a b a\nA c"), (2, "b"), (1, "a."), (3, None)]  # a repeated id counts as one document
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cells = tables.cells(spark, str(tmp_path))
    assert {tuple(r) for r in cells.collect()} == {(1, "a", 4.0), (1, "b", 1.0), (1, "c", 1.0), (2, "b", 1.0)}
    plan = tables.cells(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange ") == 1


def test_weights_side_by_side(spark):
    cells = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (2, "c", 3.0)], "item_id long, feature string, value double")
    tables_ = {"plain": cells, "weighted": bow.tfidf(cells, 2, False), "normalised": bow.tfidf(cells, 2)}
    rounded = lambda df: {(r[0], r[1], *(round(x, 9) for x in r[2:])) for r in df.select("item_id", "feature", *tables_).collect()}
    assert rounded(bow.compare_weights(cells, 2)) == rounded(bow.compare_representations(tables_))
    assert bow.compare_weights(cells, 2).where(F.col("feature") == "a").agg(F.sum("weighted")).first()[0] == 0
