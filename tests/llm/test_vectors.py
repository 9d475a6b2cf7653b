"""Vector compression and clustering against SQL on whole tables and against plain loops on awkward rows."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tandem.llm import vector_codes, zone_clusters
from tandem.llm._common import bucketed, temporary
from tandem.llm._vectors import digest, integers, nearest

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, v string, code string"


@pytest.mark.parametrize("name", ["op3_bit_sliced_topk", "op9_benchmark_containment", "op11_resident_lloyd", "op13_hilbert_zone_clusters"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS FROM '{DATA}/{t}'")
    df, want = entry.queries()[name](spark, DATA), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def floors(x, scale):
    return [math.floor(scale * float(v)) for v in x]


def lloyd(parts, books, rounds):
    """Plain Lloyd's rounds over lists of integers, then one more assignment: (index, distance) of each part."""
    def closest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(books))

    for _ in range(rounds):
        held = {}
        for p in parts:
            held.setdefault(closest(p)[1], []).append(p)
        for i, own in held.items():
            books[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [closest(p) for p in parts]


def planted(n, dims, seed, hot=0):
    """Vectors around few centres, `hot` more copies of one, whose ids come last."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 3
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.2
    return np.concatenate([x, np.repeat(x[:1], hot, axis=0)]).tolist()


def test_resident_lloyd_equals_plain_rounds(spark):
    """Owners of 16 rows, so that entries have several salts; a third of the rows is one vector."""
    x = planted(300, 7, 1, hot=150)
    df = spark.createDataFrame([(i, v, i % 3, "v", "c") for i, v in enumerate(x)], VECTORS).repartition(5)
    kept = integers(df, 1024, "embedding", df.vec_id.alias("id"), df.label)
    books = vector_codes.fit(kept, k=20, parts=4, rounds=4, owner_rows=16)
    q = [floors(v, 1024) + [0] for v in x]  # seven components in four parts of two
    for p in range(4):
        parts = [v[2 * p : 2 * p + 2] for v in q]
        want = [parts[i] for i in range(20)]
        lloyd(parts, want, 4)
        assert books[p].tolist() == want


def test_only_mail_is_shuffled(spark):
    """The owners' side of the join has no exchange, and a round's mail is smaller than the members."""
    with temporary(spark):
        owners = bucketed(spark.createDataFrame([(0, e, 0, 1, [e, e], [e, e]) for e in range(40)], vector_codes._OWNER), "owners", 4, ["position", "entry", "salt"])
        mail = owners.select("position", "entry", "salt", "members").mapInArrow(vector_codes._leaving(np.array([[[0, 0], *[[e + 0, e] for e in range(1, 40)]]]), 16), vector_codes._MAIL)
        assert mail.count() == 0  # nothing leaves
        delivered = vector_codes._delivered(mail, np.ones((1, 40), np.int64), 4)
        plan = vector_codes._settled(owners, delivered, 2)._jdf.queryExecution().executedPlan().toString()
        left = plan[plan.index("SortMergeJoin") :]
        left = left[: left.index("HashAggregate") if "HashAggregate" in left else left.index("ObjectHashAggregate")]
        assert "Bucketed: true" in left and "Exchange" not in left


def test_compress_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0]), (7, [0.5, -0.25]), (7, [0.5, -0.25]), (2, [3.0, nan]), (3, [inf, 1.0]), (4, None), (5, [1.0, None]), (6, []), (8, [1.0, 2.0, 3.0]), (9, [-1e30, 1e30]), (1, [-0.0001, 0.0])]
    df = spark.createDataFrame([(i, v, None if i == 7 else 1, "v", "c") for i, v in rows], VECTORS)
    got = sorted(vector_codes.compress(df, k=256).collect(), key=str)
    assert sorted((str(r["vec_id"]) for r in got)) == sorted(["None", "7", "7", "9", "1"])
    assert all(r["error"] == 0 and len(r["code"]) == 8 and r["label_error"] == 0 for r in got)  # each has an entry of its own
    books = np.array([[[-1], [512], [512], [-(1 << 27)], [1024]], [[0], [-256], [-256], [1 << 27], [2048]]])
    books = np.concatenate([books, np.zeros((2, 5, 1), np.int64)])
    assert {r["codebooks_sha256"] for r in got} == {digest(books)}
    assert {r["code"] for r in got if r["vec_id"] == 7} == {"01010000"}  # ties go to the lower index
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.where("vec_id = 4")).collect() == []
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(df, k=257)


def test_nearest_is_exact_beyond_doubles():
    big = 1 << 27
    x, e = np.array([[big, -big], [big - 1, -big]]), np.array([[-big, big], [big, -big + 1], [big - 1, -big]])
    for got in (nearest(x, e), nearest(x.astype(np.int32), e)):
        assert got[0].tolist() == [1, 2] and got[1].tolist() == [1, 0]
    assert nearest(x, e[:1])[1].tolist() == [2 * (2 * big) ** 2, (2 * big - 1) ** 2 + (2 * big) ** 2]


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_hilbert_curve_visits_each_cell_and_steps_to_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = zone_clusters.hilbert_keys(cells, bits)
    order = np.argsort(keys)
    assert len(np.unique(keys)) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_boxes_lose_no_nearest_centroid():
    rng = np.random.default_rng(3)
    for _ in range(300):
        c = rng.integers(-40, 40, (12, 3))
        v = rng.integers(-40, 40, (1, 3)) + rng.integers(-6, 7, (20, 3))
        near = zone_clusters.candidates(v.min(0), v.max(0), c)
        d = ((v[:, None] - c) ** 2).sum(2)
        assert {int(i) for row in d for i in np.flatnonzero(row == row.min())} <= set(near.tolist())  # ties too


def test_clusters_equal_plain_rounds_and_boxes_save_work(spark):
    x = planted(3000, 4, 2, hot=1500)
    df = spark.createDataFrame([(i % 4000, v, 0, "v", "c") for i, v in enumerate(x)], VECTORS).repartition(5)  # 500 ids twice
    shares = []
    got = sorted((r["vec_id"], r["distance"], r["cluster"], r["cluster_inertia"], r["inertia"]) for r in zone_clusters.cluster(df, k=9, dims=4, rounds=3, shares=shares).collect())
    import hashlib

    q = [(i % 4000, floors(v, 256)) for i, v in enumerate(x)]
    seeds = sorted(q, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:9]
    found = lloyd([v for _, v in q], [v for _, v in seeds], 3)
    sums = {}
    for d, c in found:
        sums[c] = sums.get(c, 0) + d
    assert got == sorted((i, d, c, sums[c], sum(sums.values())) for (i, _), (d, c) in zip(q, found, strict=True))
    assert len(shares) == 3 and max(shares) < 0.5


def test_cluster_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0]), (7, [0.5, -0.25]), (7, [0.5, -0.25]), (2, [3.0, nan]), (3, [-inf, 1.0]), (4, None), (5, [None, 1.0]), (6, []), (8, [1.0, 2.0, 3.0]), (9, [-1e30, 1e30])]
    df = spark.createDataFrame([(i, v, 1, "v", "c") for i, v in rows], VECTORS)
    got = zone_clusters.cluster(df, k=40, dims=2).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["7", "7", "9", "None"]
    assert {r["distance"] for r in got} == {0} and {r["inertia"] for r in got} == {0}
    assert len({r["cluster"] for r in got if r["vec_id"] == 7}) == 1  # ties go to the smaller number
    assert zone_clusters.cluster(df.limit(0), dims=2).count() == 0
    far = spark.createDataFrame([(i, [s * 1e30] * 64, 1, "v", "c") for i, s in enumerate((1, -1) * 40)], VECTORS)
    assert zone_clusters.cluster(far, k=1, dims=64, rounds=1).select("inertia").distinct().collect()[0]["inertia"] is None  # beyond 64 bits
