"""Scans over whole sequences in many range parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import items, scale, scan


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_runs_cross_parts(spark, parts):
    rng = random.Random(parts)
    docs = []
    while len(docs) < 500:
        docs += [rng.choice(["a", "b", None])] * rng.choice([1, 2, 5, 120])  # longer than a part
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i long, doc string").repartition(9)
    want, run = [], 0
    for i, d in enumerate(docs):
        run += i > 0 and d != docs[i - 1]
        want.append((i, d, run))
    got = scan.runs_of_all(rows, ["i"], "doc", parts)
    assert sorted((tuple(r[c] for c in ("i", "doc", "run")) for r in got.collect()), key=lambda r: r[0]) == want


def test_gaps_cross_parts(spark):
    rng = random.Random(3)
    values = sorted({round(rng.choice([rng.uniform(0, 5), rng.uniform(40, 60), rng.uniform(1000, 1003)]), 3) for _ in range(400)})
    want, at = {}, values[0]
    for a, b in zip([values[0], *values], values, strict=False):
        at += min(b - a, 1)
        want[b] = at
    rows = spark.createDataFrame([(v,) for v in values], "value double").repartition(5)
    for out in (scan.squish_all(rows, parts=11), scale.squish(rows, None)):
        got = {r["value"]: r["squished"] for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[v] == pytest.approx(want[v], abs=1e-9) for v in want)


def test_empty_and_summed(spark):
    rows = spark.createDataFrame([(1, "x", 2.0), (2, "x", 3.0), (3, "y", 4.0)], "i long, doc string, v double")
    assert sorted(map(tuple, items.aggregate_runs(rows, [], ["i"], "doc", {"v": "v"}).collect())) == [(0, "x", 5.0), (1, "y", 4.0)]
    assert items.aggregate_runs(rows.limit(0), [], ["i"], "doc", {"v": "v"}).count() == 0
    assert scale.squish(rows.select(F.col("v").alias("value")).limit(0), None).count() == 0
