"""Duplicates with two thresholds, and the block pairs that pivots leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import layers, random, retrieve, vector_blocks


def table(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "item_id long, vec array<double>").repartition(parts)


def bent(n, dims, seed):
    """Groups of near vectors, at angles that lie on either side of both thresholds."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dims))
    x = np.repeat(centres, 8, axis=0) + rng.normal(size=(n // 8 * 8, dims)) * rng.choice([0.0, 0.1, 0.25, 0.5], (n // 8 * 8, 1))
    return x[rng.permutation(len(x))]


def scan(x, same, cross, digits):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, digits)
    n = len(x)
    wanted = np.where((np.arange(n)[:, None] - np.arange(n)) % 2 == 0, same, cross)
    root = {}
    for i in range(n):
        if i not in root:
            root[i] = i
            root |= {j: i for j in range(i + 1, n) if j not in root and sims[i, j] >= wanted[i, j]}
    return root


@pytest.mark.parametrize(("same", "cross"), [(0.98, 0.9), (0.9, 0.98)])
def test_two_thresholds_equal_the_scan(spark, tmp_path, same, cross):
    x = bent(320, 12, 4)
    x[40:80] = x[40]  # equal vectors in both families
    got = retrieve.duplicates_of_vectors(table(spark, x), same, str(tmp_path / "d"), digits=5, cross=cross, family=lambda i: i % 2).collect()
    assert {r["item_id"]: r["representative"] for r in got} == scan(x, same, cross, 5)


def test_pivots_keep_every_pair_and_leave_few_blocks(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 30, axis=0) + rng.normal(size=(1200, 16)) * 0.05
    x = x[rng.permutation(1200)]
    blocks = vector_blocks.angle_blocks(table(spark, x), pivots=32, block_rows=32)
    n = blocks.count()
    met = vector_blocks.near_blocks(blocks, 0.95)
    assert met.count() < n * (n + 1) / 2 / 3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    got = {(r["query_id"], r["target_id"]) for r in vector_blocks.pairs_of_blocks(blocks, met, 0.95, 6).collect()}
    assert got == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(sims >= 0.95)), strict=True) if a < b}
    assert sum(len(r["ids"]) for r in blocks.collect()) == 1200


def test_no_vectors(spark, tmp_path):
    empty = table(spark, np.zeros((3, 2)))
    got = retrieve.duplicates_of_vectors(empty, 0.9, str(tmp_path / "e")).collect()
    assert {r["item_id"]: r["representative"] for r in got} == {0: 0, 1: 1, 2: 2}


def test_numbers_agree_between_spark_sql_and_numpy(spark):
    import duckdb

    rows = spark.range(50).select("id", (F.col("id") % 3).alias("k"), random.hash_uniform("id", "k", seed=8).alias("u")).collect()
    con = duckdb.connect()
    want = dict(con.sql(f"SELECT id, {random.uniform_sql('id', 'id % 3', seed=8)} FROM range(50) t(id)").fetchall())
    assert {r["id"]: r["u"] for r in rows} == want
    one = layers._uniform([5], 3, 8)[0].tolist()
    assert one == [spark.range(1).select(random.hash_uniform(F.lit(5), F.lit(j), seed=8)).first()[0] for j in range(3)]
    u = np.array(list(want.values()))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.15


@pytest.mark.parametrize(("same", "cross"), [(0.98, 0.9), (0.4, 0.3)])
def test_first_items_are_decided_ahead(spark, tmp_path, same, cross):
    """What the first items absorb is in no pair that is listed."""
    x = bent(320, 12, 9)
    x[100:140] = x[3]
    path = str(tmp_path / "d")
    got = retrieve.duplicates_of_vectors(table(spark, x), same, path, digits=5, cross=cross, family=lambda i: i % 2, ahead=48).collect()
    want = scan(x, same, cross, 5)
    assert {r["item_id"]: r["representative"] for r in got} == want and len(got) == 320
    listed = spark.read.parquet(f"{path}/rest-pairs")
    first = {i for i in want if i < 48 and want[i] == i}
    taken = {i for i in want if i >= 48 and want[i] in first}
    assert not taken & {v for r in listed.collect() for v in r}


def test_a_block_is_sent_once_for_each_group(spark):
    """Every pair of 24 blocks meets; each of them is sent to the tasks of three groups, not to 24 others."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(384, 8))
    blocks = vector_blocks.angle_blocks(table(spark, x), pivots=4, block_rows=16)
    met = vector_blocks.near_blocks(blocks, 0.3)
    assert met.count() > 3 * blocks.count()
    found = vector_blocks.pairs_of_blocks(blocks, met, 0.3, 6, groups=3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    got = {(r["query_id"], r["target_id"]): r["sim"] for r in found.collect()}
    assert got.keys() == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(sims >= 0.3)), strict=True) if a < b}
    assert max(abs(v - sims[k]) for k, v in got.items()) < 1e-9


def test_candidates_in_single_precision_lose_none():
    rng = np.random.default_rng(1)
    x, y = (vector_blocks.unit(rng.normal(size=(300, 7)).round(1)) for _ in range(2))
    r, c, sims = vector_blocks.close(x, y, 0.5, 3)
    whole = np.round(x @ y.T, 3)
    assert {(a, b) for a, b in zip(r.tolist(), c.tolist(), strict=True)} == set(zip(*map(np.ndarray.tolist, np.nonzero(whole >= 0.5)), strict=True))
