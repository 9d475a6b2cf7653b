"""Queries of vector compression and clustering."""

from __future__ import annotations

from tandem.llm.vector_codes import compress
from tandem.llm.zone_clusters import cluster


def op11_resident_lloyd(spark, sf_dir):
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=256, parts=4, scale=1024, rounds=4)


def op13_hilbert_zone_clusters(spark, sf_dir):
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, dims=64, scale=256, rounds=5, seed="2:")


_KEPT = """
f AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) > 0),
g AS (SELECT * FROM f WHERE len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0)"""
_SQUARED = "list_dot_product(v, v) - 2 * list_dot_product(v, e) + list_dot_product(e, e)"


def _op11_sql(rounds: int = 4) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, position, any_value(v) AS v, min(CAST({_SQUARED} AS BIGINT) * 256 + entry) AS best FROM p JOIN c{i} USING (position) GROUP BY r, position)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT position, best % 256 AS entry, unnest(v) AS y, unnest(range(len(v))) AS j FROM a{i}),
m{i} AS (SELECT position, entry, j, floor(sum(y) / count(*)) AS y FROM s{i} GROUP BY ALL),
n{i} AS (SELECT position, entry, list(y ORDER BY j) AS e FROM m{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT position, entry, coalesce(n{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN n{i} USING (position, entry))""")
    return f"""
WITH {_KEPT},
k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, list_transform(x, lambda y: floor(1024 * y)) AS q FROM g),
p AS MATERIALIZED (SELECT r, position, q[position * 16 + 1 : position * 16 + 16] AS v FROM k, (SELECT unnest(range(4)) AS position)),
c0 AS MATERIALIZED (SELECT position, r - 1 AS entry, v AS e FROM p WHERE r <= 256),{",".join(steps)},
d AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY position, entry, j)) AS codebooks_sha256
      FROM (SELECT position, entry, unnest(e) AS y, unnest(range(len(e))) AS j FROM c{rounds})),
o AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY position) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), d
"""


def _op13_sql(rounds: int = 5) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, any_value(v) AS v, min(CAST({_SQUARED} AS BIGINT) * 64 + cluster) AS best FROM k, c{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT best % 64 AS cluster, unnest(v) AS y, unnest(range(64)) AS j FROM a{i}),
m{i} AS (SELECT cluster, j, floor(sum(y) / count(*)) AS y FROM s{i} GROUP BY ALL),
n{i} AS (SELECT cluster, list(y ORDER BY j) AS e FROM m{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN n{i} USING (cluster))""")
    return f"""
WITH {_KEPT},
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, vec_id NULLS LAST, x) AS r, vec_id, list_transform(x, lambda y: floor(256 * y)) AS v FROM g WHERE len(x) = 64),
c0 AS (SELECT r - 1 AS cluster, v AS e FROM k WHERE r <= 40),{",".join(steps)},
d AS (SELECT cluster, sha256(array_to_string(list_transform(e, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{rounds}),
o AS (SELECT r, best % 64 AS cluster, best // 64 AS distance FROM a{rounds})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM k JOIN o USING (r) JOIN d USING (cluster)
"""


QUERIES = {"op11_resident_lloyd": op11_resident_lloyd, "op13_hilbert_zone_clusters": op13_hilbert_zone_clusters}
SQL = {"op11_resident_lloyd": _op11_sql(), "op13_hilbert_zone_clusters": _op13_sql()}
