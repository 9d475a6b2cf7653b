"""Sparse top-k against all pairs, and how much of the postings it reads."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import retrieve, sparse_index


def make(spark, rng, n, common, sign=1):
    """Items of some rare features and, if asked for, one light feature that every item has."""
    rows = []
    for i in range(n):
        own = {f"f{min(rng.randrange(200), rng.randrange(200))}": rng.choice([1, 2, 3]) * rng.choice([1, sign]) for _ in range(rng.randrange(1, 7))}
        if common:
            own["all"] = 0.3
        norm = math.sqrt(sum(v * v for v in own.values()))
        rows += [(i, f, v / norm) for f, v in own.items()]
    return rows, spark.createDataFrame(rows, "item_id long, feature string, value double")


def plain(rows, k, digits, every=10):
    vectors = {}
    for i, f, v in rows:
        vectors.setdefault(i, {})[f] = v
    out = set()
    for i, q in vectors.items():
        if i % every == 0:
            sims = [(-round(sum(q[f] * d[f] for f in q.keys() & d.keys()), digits) + 0.0, j) for j, d in vectors.items() if q.keys() & d.keys()]
            out |= {(i, j, -s + 0.0, r + 1) for r, (s, j) in enumerate(sorted(sims)[:k])}
    return out


@pytest.mark.parametrize(("common", "sign", "k"), [(True, 1, 5), (False, -1, 3), (True, -1, 400)])
def test_topk_equals_all_pairs(spark, monkeypatch, common, sign, k):
    monkeypatch.setattr(sparse_index, "PLAIN", 0)  # always by the bounds
    monkeypatch.setattr(sparse_index, "MOST", 1)
    rows, cells = make(spark, random.Random(k), 300, common, sign)
    got = retrieve.similarity_topk_sparse(cells.where("item_id % 10 = 0"), cells, k, digits=4).collect()
    assert {(r["query_id"], r["target_id"], r["sim"] + 0.0, r["rank"]) for r in got} == plain(rows, k, 4)


def test_a_feature_of_every_item_is_not_read(spark):
    """The joined rows are those of the needed postings: far fewer than of all shared features."""
    rows, cells = make(spark, random.Random(2), 1500, True)
    queries = cells.where("item_id % 10 = 0")
    d, postings = sparse_index.indexed(cells)
    needed = sparse_index.needed_cells(queries, d, postings, 3, 4)
    whole = needed.agg(F.sum("n")).first()[0]
    read = needed.where("needed").agg(F.sum("n")).first()[0]
    assert whole > sparse_index.PLAIN * len(rows) and read < whole / 4
    assert needed.where("feature = 'all' AND needed").count() < 0.2 * 150
    assert {r["feature"]: r["parts"] for r in sparse_index._hot(postings, 100).collect()}["all"] == 15
    got = sparse_index.topk(queries, cells, 3, 4, part_rows=100)
    want = sparse_index.all_pairs(queries, cells, part_rows=100)
    assert retrieve.ranked(got, 3, 4).exceptAll(retrieve.ranked(want, 3, 4)).count() == 0
    assert retrieve.ranked(got, 3, 4).count() == 450


def test_no_rows(spark):
    cells = spark.createDataFrame([(1, "a", 1.0)], "item_id long, feature string, value double")
    assert retrieve.similarity_topk_sparse(cells.limit(0), cells).count() == 0
    assert retrieve.similarity_topk_sparse(cells, cells.limit(0)).count() == 0
    assert retrieve.similarity_topk_sparse(cells, cells, k=None).count() == 1
