"""Queries on numeric transforms, items, and matrix statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import bow as B
from tandem.operators import items as D
from tandem.operators import scale as N
from tandem.operators import stats as M
from tandem.operators.random import bits_sql, uniform_sql
from tandem.plans import tables as X
from tandem.plans.registry import query

_M = f"WITH {X.MATRIX} "
_R = "SELECT item_id, feature, round({}, 6) AS value FROM m"


def _r(df):
    return df.select("item_id", "feature", F.round("value", 6).alias("value"))


def _n(s, d):
    return X.table(s, d, "orders").count()


def _dim(s, d):
    return X.table(s, d, "part").count()


@query(_M + _R.format("value / sum(value) OVER (PARTITION BY item_id)"))
def norm_sum(s, d):
    return _r(N.normalize_sum(X.matrix(s, d)))


@query(_M + ", c AS (SELECT min(c) AS c FROM (SELECT sum(value) * 0.9999 / greatest(max(value), 1e-5) AS c FROM m GROUP BY item_id)) " + _R.format("value * c / sum(value) OVER (PARTITION BY item_id)").replace("6)", "12)") + ", c")
def norm_capped(s, d):
    return N.normalize_capped(X.matrix(s, d)).select("item_id", "feature", F.round("value", 12).alias("value"))


@query(_M + _R.format("value / max(value) OVER (PARTITION BY item_id)"))
def scale_item_max(s, d):
    return _r(N.scale_item_max(X.matrix(s, d)))


@query(_M + _R.format("least(value, 40) / 40"))
def scale_global(s, d):
    return _r(N.scale_global_max(X.matrix(s, d), 40.0))


@query(_M + _R.format("2 / (1 + exp(-0.05 * value)) - 1"))
def sigmoid(s, d):
    return _r(X.matrix(s, d).withColumn("value", N.sigmoid(F.col("value"), 2.0, 0.05, 1.0)))


@query(_M + _R.format("0.99975 * tanh(0.05 * value)"))
def tanh_apply(s, d):
    return _r(X.matrix(s, d).withColumn("value", N.apply_fn(F.col("value"), mul=0.05)))


@query(_M + _R.format("tanh(value / 10)"))
def tanh_scale(s, d):
    return _r(X.matrix(s, d).withColumn("value", N.tanh_scaled(F.col("value"), 10.0)))


@query(_M + _R.format("value / (value + 5)"))
def hyperbolic(s, d):
    return _r(X.matrix(s, d).withColumn("value", N.hyperbolic(F.col("value"), 5.0)))


_MOM = _M + ", k AS (SELECT feature, sum(value * value) / (SELECT count(*) FROM orders) AS c FROM m GROUP BY feature) "


@query(_MOM + "SELECT item_id, feature, round(value * sqrt(1 / c), 6) AS value FROM m JOIN k USING (feature)")
def uniform_var(s, d):
    return _r(N.uniform_variance(X.matrix(s, d), _n(s, d)))


@query(_MOM + ", a AS (SELECT avg(c) AS a FROM k) SELECT item_id, feature, round(value * sqrt(a / c), 6) AS value FROM m JOIN k USING (feature), a")
def scale_covariance(s, d):
    return _r(N.scale_to_average_covariance(X.matrix(s, d), _n(s, d)))


@query(_M + ", k AS (SELECT feature, sum(value) / (SELECT count(*) FROM orders) AS mu, sum(value * value) / (SELECT count(*) FROM orders) AS s FROM m GROUP BY feature) SELECT item_id, feature, round((value - mu) / sqrt(s - mu * mu), 6) AS value FROM m JOIN k USING (feature)")
def standard_scale(s, d):
    return _r(N.standard_scale(X.matrix(s, d), _n(s, d)))


@query(f"WITH {X.VECTORS} SELECT item_id, CAST(i - 1 AS INTEGER) AS feature, round(vec[i], 6) AS value FROM (SELECT item_id, vec, unnest(range(1, len(vec) + 1)) AS i FROM v) WHERE abs(vec[i]) > 1e-9")
def to_sparse(s, d):
    return _r(N.to_sparse(X.vectors(s, d)))


@query(f"WITH {X.VECTORS} SELECT item_id, round(list_sum(vec), 4) AS total, len(vec) AS dim FROM v")
def to_dense(s, d):
    dense = N.to_dense(N.to_sparse(X.vectors(s, d)), 64)
    return dense.select("item_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("vec").cast("long").alias("dim"))


@query(_M + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY value DESC, feature) AS r FROM m) SELECT item_id, feature, value FROM r WHERE r <= 2")
def retain_top(s, d):
    return N.retain_top(X.matrix(s, d), 2)


@query(_M + ", x AS (SELECT DISTINCT item_id, value FROM m), g AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 ELSE least(value - lag(value) OVER w, 1) END AS gap, min(value) OVER (PARTITION BY item_id) AS lo FROM x WINDOW w AS (PARTITION BY item_id ORDER BY value)) SELECT item_id, value, round(lo + sum(gap) OVER (PARTITION BY item_id ORDER BY value ROWS UNBOUNDED PRECEDING), 6) AS squished FROM g")
def squish(s, d):
    return N.squish(X.matrix(s, d).select("item_id", "value").distinct(), "item_id").withColumn("squished", F.round("squished", 6))


@query(_M + "SELECT item_id, feature, value FROM m ORDER BY value DESC, item_id, feature LIMIT 50")
def n_max(s, d):
    return N.n_max(X.matrix(s, d), 50)


@query(f"WITH {X.VECTORS} SELECT item_id, round(greatest(vec[1], 1e-4), 6) AS relu, round(least(greatest(vec[1], 1e-4), 0.1), 6) AS capped, round(greatest(vec[1], 0) * (item_id % 2), 6) AS masked, round(abs(tanh(vec[1])), 6) AS abs_tanh, list_transform(range(4), lambda i: CAST(i = item_id % 4 AS DOUBLE))[2] AS hot FROM v")
def activations(s, d):
    x = F.col("vec")[0]
    hot = N.one_hot(4, F.col("item_id") % 4)
    return X.vectors(s, d).select(
        "item_id", F.round(N.relu(x), 6).alias("relu"), F.round(N.capped_relu(x, 0.1), 6).alias("capped"),
        F.round(N.masked_relu(x, F.col("item_id") % 2), 6).alias("masked"), F.round(N.abs_tanh(x), 6).alias("abs_tanh"), hot[1].alias("hot"),
    )


@query(_M + f", k AS (SELECT feature FROM (SELECT DISTINCT feature FROM m) ORDER BY {bits_sql('feature', seed=3)}, feature LIMIT 100), n AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS new_feature FROM k) SELECT item_id, CAST(new_feature AS INTEGER) AS feature, value FROM m JOIN n USING (feature)")
def random_features(s, d):
    return N.select_random_features(X.matrix(s, d), 100, seed=3)


@query(_M + f"SELECT item_id, feature, value FROM m WHERE {uniform_sql('item_id', 'feature', seed=3)} >= 0.3")
def zero_mask(s, d):
    return N.zero_mask(X.matrix(s, d), 0.3, seed=3)


@query(_M + f", p AS (SELECT item_id, feature, value / sum(value) OVER (PARTITION BY item_id) AS p FROM m) SELECT item_id, feature, CASE WHEN {uniform_sql('item_id', 'feature', seed=3)} < p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM p")
def bernoulli(s, d):
    return N.bernoulli_sample(N.normalize_sum(X.matrix(s, d)), seed=3)


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def drop_empty(s, d):
    return D.drop_empty_items(X.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id")), X.matrix(s, d))


@query("SELECT o_orderkey AS old_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_id FROM orders WHERE o_orderkey % 3 = 0")
def filter_items(s, d):
    return D.filter_items(X.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id")), F.col("item_id") % 3 == 0)


@query(_M + ", f AS (SELECT o_orderkey AS old_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_id FROM orders WHERE o_orderkey % 3 = 0) SELECT new_id AS item_id, feature, value FROM m JOIN f ON item_id = old_id")
def filter_like(s, d):
    return D.filter_like(X.matrix(s, d), filter_items(s, d)).select("item_id", "feature", "value")


@query("SELECT doc_id AS position, vec_id AS item_id, label FROM documents JOIN embeddings ON vec_id = (doc_id * 7 + 3) % (SELECT count(*) FROM embeddings)")
def reorder(s, d):
    v = X.vectors(s, d).select("item_id", "label")
    mapping = X.table(s, d, "documents").select(F.col("doc_id").alias("position"), ((F.col("doc_id") * 7 + 3) % v.count()).alias("item_id"))
    return D.reorder(v, mapping).select("position", "item_id", "label")


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN role IS DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS change FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
r AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn, role, n ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY ALL""")
def aggregate_runs(s, d):
    rows = X.table(s, d, "conversations").withColumn("n", F.length("text"))
    return D.aggregate_runs(rows, ["conv_id"], ["turn", "role", "text"], "role", {"total": "n"})


@query("""WITH c AS (SELECT event_type, user_id % 3 AS doc, CAST(event_id % 7 AS DOUBLE) AS n, event_id, CASE WHEN user_id % 3 IS DISTINCT FROM lag(user_id % 3) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 1 ELSE 0 END AS change FROM events),
r AS (SELECT *, sum(change) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT CAST(run AS BIGINT) AS run, doc, sum(n) AS total FROM r GROUP BY ALL""")
def aggregate_runs_all(s, d):
    """All events as one sequence, whose runs cross the range parts."""
    rows = X.table(s, d, "events").select("event_id", (F.col("user_id") % 3).alias("doc"), (F.col("event_id") % 7).cast("double").alias("n"))
    return D.aggregate_runs(rows, [], ["event_id"], "doc", {"total": "n"})


@query("WITH x AS (SELECT DISTINCT CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem), g AS (SELECT value, lag(value) OVER (ORDER BY value) AS before, min(value) OVER () AS lo FROM x) SELECT value, round(lo + sum(CASE WHEN before IS NULL THEN 0 ELSE least(value - before, 1) END) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING), 4) AS squished FROM g")
def squish_all(s, d):
    values = X.table(s, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("value")).distinct()
    return N.squish(values, None).withColumn("squished", F.round("squished", 4))


@query(_M + "SELECT o_custkey AS doc_name, feature, sum(value) AS value FROM m JOIN orders ON item_id = o_orderkey GROUP BY ALL")
def aggregate_documents(s, d):
    items = X.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("doc_name"))
    return D.aggregate_documents(X.matrix(s, d), items)


@query(_M + "SELECT item_id || ':' || feature AS new_item, item_id, feature, value FROM m WHERE value <> 0")
def split_feature(s, d):
    return D.split_per_feature(X.matrix(s, d))


def _ranked(s, d):
    return B.with_ids(X.table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "position")


_RANKED = "p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)"
_SPLIT = f"WITH {_RANKED}, s AS (SELECT o_orderkey, position, CASE WHEN position >= n - floor(n * 0.2) THEN 'test' WHEN position >= n - floor(n * 0.2) - floor(n * 0.1) THEN 'devel' ELSE 'train' END AS split FROM p)"


@query(_SPLIT + " SELECT * FROM s")
def split_tdt(s, d):
    return D.split_train_devel_test(_ranked(s, d), _n(s, d), 0.2, 0.1)


@query(_SPLIT + ", b AS (SELECT *, CAST(floor((position - min(position) OVER w) / 64) AS BIGINT) AS batch, count(*) OVER w AS c FROM s WINDOW w AS (PARTITION BY split)) SELECT o_orderkey, position, split, batch FROM b WHERE batch < floor(c / 64)")
def assign_batches(s, d):
    return D.assign_batches(D.split_train_devel_test(_ranked(s, d), _n(s, d), 0.2, 0.1), 64)


@query(f"WITH {_RANKED} SELECT o_orderkey, position, CAST((n - 1 - position) // (n // 7) AS BIGINT) AS step FROM p WHERE (n - 1 - position) % (n // 7) = 0 AND (n - 1 - position) // (n // 7) < 7")
def uniform_steps(s, d):
    return D.uniform_steps(_ranked(s, d), _n(s, d), 7)


@query(f"SELECT o_orderkey FROM orders ORDER BY {bits_sql('o_orderkey', seed=5)}, o_orderkey LIMIT 20")
def random_steps(s, d):
    return D.random_steps(X.table(s, d, "orders").select("o_orderkey"), 20, "o_orderkey", 5)


@query(f"SELECT o_orderkey FROM orders ORDER BY {bits_sql('o_orderkey', seed=6)}, o_orderkey LIMIT 100")
def sample_items(s, d):
    return D.sample(X.table(s, d, "orders").select("o_orderkey"), 100, "o_orderkey", 6)


_SIZE = "(SELECT count(*) FROM orders) * (SELECT count(*) FROM part)"


@query(_M + f"SELECT (SELECT count(*) FROM orders) AS items, (SELECT count(*) FROM part) AS dim, round(sum(value), 4) AS total, round(sum(value) / ({_SIZE}), 8) AS avg_cell, least(min(value), 0) AS min, max(value) AS max, count(*) FILTER (value <> 0) AS nonzero FROM m")
def matrix_stats(s, d):
    return M.matrix_stats(X.matrix(s, d), _n(s, d), _dim(s, d)).withColumns({"total": F.round("total", 4), "avg_cell": F.round("avg_cell", 8)})


@query(_M + "SELECT item_id AS id, round(sum(value), 4) AS total FROM m GROUP BY item_id")
def item_sums(s, d):
    return M.axis_sums(X.matrix(s, d)).select(F.col("item_id").alias("id"), F.round("total", 4).alias("total"))


@query(_M + "SELECT feature AS id, round(sum(value), 4) AS total FROM m GROUP BY feature")
def feature_sums(s, d):
    return M.axis_sums(X.matrix(s, d), "feature").select(F.col("feature").alias("id"), F.round("total", 4).alias("total"))


@query(_M + ", x AS (SELECT CAST(round(value / 100 * 100) AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY 1), e AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM x) SELECT e.bin, coalesce(n, 0) AS n FROM e LEFT JOIN x USING (bin)")
def cell_hist(s, d):
    return M.cell_histogram(X.matrix(s, d).withColumn("value", F.col("value") / 100))


@query(_M + ", z AS (SELECT o_orderkey, count(feature) AS nnz FROM orders LEFT JOIN m ON item_id = o_orderkey GROUP BY 1) SELECT nnz - nnz % 10 AS bin, count(*) AS n FROM z GROUP BY 1")
def nnz_hist(s, d):
    return M.nnz_histogram(X.matrix(s, d), X.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id")))


_MASS = _M + ", h AS (SELECT least(floor(value * 20 / 60), 19) AS bin, count(*) AS n FROM m GROUP BY 1), k AS (SELECT CAST(bin AS BIGINT) AS bin, n, n * bin * 60 / 20 AS mass FROM h), c AS (SELECT *, sum(mass) OVER (ORDER BY bin) / sum(mass) OVER () AS cumulative FROM k) "


@query(_MASS + "SELECT bin, n, round(mass, 4) AS mass, round(cumulative, 6) AS cumulative FROM c")
def cum_mass(s, d):
    return M.cumulative_mass(M.mass_histogram(X.matrix(s, d), 20, 60.0)).withColumns({"mass": F.round("mass", 4), "cumulative": F.round("cumulative", 6)})


@query(_MASS + "SELECT min(bin) FILTER (cumulative >= 0.9) AS p90, min(bin) FILTER (cumulative >= 0.95) AS p95 FROM c")
def mass_points(s, d):
    return M.mass_points(M.cumulative_mass(M.mass_histogram(X.matrix(s, d), 20, 60.0)))


@query(_M + ", k AS (SELECT count(*) AS n FROM orders) SELECT feature, round(1 - count(*) / any_value(n), 6) AS zeros, round(sum(value) / any_value(n), 6) AS mean, round(avg(value), 6) AS nonzero_mean, round(count(*) FILTER (value >= 45) / any_value(n), 6) AS saturated, round(avg(value) FILTER (value >= 45), 6) AS top_mean FROM m, k GROUP BY feature")
def rich_histogram(s, d):
    return M.rich_histogram(X.matrix(s, d), _n(s, d), 45.0).select("feature", *[F.round(c, 6).alias(c) for c in ("zeros", "mean", "nonzero_mean", "saturated", "top_mean")])


@query(_MOM + "SELECT feature, round(c, 6) AS moment FROM k")
def second_moments(s, d):
    return N.second_moments(X.matrix(s, d), _n(s, d)).withColumn("moment", F.round("moment", 6))


_PAIRS = f"WITH {X.VECTORS}, u AS (SELECT i, j, vec[i + 1] AS x, vec[j + 1] AS y FROM v, range(64) a(i), range(64) b(j) WHERE i < j) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "


def _dims(s, d):
    v = X.vectors(s, d)
    c = v.select("item_id", F.posexplode("vec").alias("feature", "value"))
    return c, s.range(64).select(F.col("id").cast("int").alias("feature")), v.count()


@query(_PAIRS + "round(avg((x - y) * (x - y)), 6) AS value FROM u GROUP BY i, j")
def pair_features(s, d):
    c, f, n = _dims(s, d)
    return M.pairwise_features(c, f, M.pair_mse, n).withColumn("value", F.round("value", 6))


@query(_PAIRS + "round(corr(x, y), 6) AS value FROM u GROUP BY i, j")
def correlation(s, d):
    c, f, n = _dims(s, d)
    return M.correlation_matrix(c, f, n).withColumn("value", F.round("value", 6))


_GRID = "SELECT '{0}' AS metric, round(avg({1}), 6) AS average, 2 * count(*) AS cells FROM (SELECT {2} AS value FROM u GROUP BY i, j)"


@query(_PAIRS.replace("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, ", "") + _GRID.format("mse", "value", "avg((x - y) * (x - y))") + " UNION ALL " + _GRID.format("correlation", "value", "corr(x, y)"))
def grid_averages(s, d):
    c, f, n = _dims(s, d)
    rows = [M.grid_average(p).select(F.lit(name).alias("metric"), F.round("average", 6).alias("average"), "cells") for name, p in (("mse", M.pairwise_features(c, f, M.pair_mse, n)), ("correlation", M.correlation_matrix(c, f, n)))]
    return rows[0].unionByName(rows[1])


@query(f"WITH {X.VECTORS}, u AS (SELECT vec[1] AS x, vec[2] AS y FROM v) SELECT round(avg((x - y) ** 2), 6) AS mse, round(sqrt(avg((x - y) ** 2)), 6) AS rmse, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y) ** 2)) / (greatest(max(x), max(y)) - least(min(x), min(y))), 6) AS range_rmse FROM u")
def column_distances(s, d):
    out = M.column_distances(X.vectors(s, d).select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "range_rmse")])


@query(f"WITH {X.VECTORS}, u AS (SELECT item_id, vec[1] AS x, vec[2] AS y FROM v), a AS (SELECT x, row_number() OVER (ORDER BY x, item_id) AS r FROM u), b AS (SELECT y, row_number() OVER (ORDER BY -y, item_id) AS r FROM u) SELECT round((SELECT sqrt(avg((x - y) ** 2)) FROM u) / sqrt(avg((x - y) ** 2)), 6) AS max_rmse FROM a JOIN b USING (r)")
def max_normalised_rmse(s, d):
    out = M.max_normalised_rmse(X.vectors(s, d).select("item_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), "item_id")
    return out.withColumn("max_rmse", F.round("max_rmse", 6))


@query(_M + "SELECT feature, round(sum(value) / (SELECT sum(value) FROM m), 8) AS share FROM m GROUP BY feature")
def feature_share(s, d):
    return M.feature_share(X.matrix(s, d)).withColumn("share", F.round("share", 8))


@query(_M + "SELECT feature, round(count(*) / (SELECT count(*) FROM orders), 6) AS density FROM m WHERE value <> 0 GROUP BY feature")
def feature_density(s, d):
    return M.feature_density(X.matrix(s, d), _n(s, d)).withColumn("density", F.round("density", 6))


@query(_M + f", x AS (SELECT sum(value) AS s, sum(value * value) AS ss, CAST({_SIZE} AS DOUBLE) AS n FROM m) SELECT round(s / n, 6) AS mean, round(ss - s * s / n, 2) AS total_sq, round((ss - s * s / n) / n, 6) AS mean_sq FROM x")
def dispersion(s, d):
    out = M.dispersion(X.matrix(s, d), _n(s, d), _dim(s, d))
    return out.select(F.round("mean", 6).alias("mean"), F.round("total_sq", 2).alias("total_sq"), F.round("mean_sq", 6).alias("mean_sq"))


@query(_MOM + ", a AS (SELECT avg(c) AS a FROM k) SELECT feature, round(c, 6) AS before, round(a, 6) AS after FROM k, a")
def covariance_before_after(s, d):
    return M.covariance_before_after(X.matrix(s, d), _n(s, d)).select("feature", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))
