"""X'X by tiles against numpy, with several tiles, little room for them, and tiles that no item has."""

import numpy as np
import pytest

from tandem.operators import gram, stats


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((300, 40)) < 0.15, rng.integers(-5, 6, (300, 40)), 0).astype(float)
    x[:, :20][150:] = 0  # items have features of the first or of the last blocks only
    x[:, 20:][:150] = 0
    x[:, 7] = 0  # a feature without cells
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return x, spark.createDataFrame([*rows, (1, 100, 3.0)], "item_id long, feature int, value double").repartition(6)


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_tiles_add_up(spark, matrix, held):
    x, cells = matrix
    used = [j for j in range(40) if j != 7]
    pairs, moments = gram.gram(cells, spark.createDataFrame([(j,) for j in used], "feature int"), tile=8, held=held, groups=3)
    want = x.T @ x
    got = {(r["i"], r["j"]): r["s"] for r in pairs.collect()}
    assert got == {(i, j): want[i, j] for i in used for j in used if i < j}
    assert {r["feature"]: (r["s"], r["ss"]) for r in moments.collect()} == {j: (x[:, j].sum(), want[j, j]) for j in used}


def test_metrics_and_their_average(spark, matrix):
    x, cells = matrix
    features = spark.createDataFrame([(j,) for j in range(40)], "feature int")
    pairs = stats.pairwise_features(cells, features, stats.pair_correlation, 300)
    got = {(r["i"], r["j"]): r["value"] for r in pairs.collect()}
    used = [j for j in range(40) if j != 7]
    want = np.corrcoef(x[:, used].T)
    for a, i in enumerate(used):
        for b, j in enumerate(used):
            if i < j:
                assert got[i, j] == pytest.approx(want[a, b], abs=1e-9)
    row = stats.grid_average(pairs).first()
    assert row["cells"] == 39 * 38
    assert row["average"] == pytest.approx((want.sum() - 39) / (39 * 38), abs=1e-9)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
