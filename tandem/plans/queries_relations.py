"""Queries on links, retrieval, annotations and layers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tandem.operators import agree as A
from tandem.operators import bow as B
from tandem.operators import layers as L
from tandem.operators import link as J
from tandem.operators import retrieve as R
from tandem.operators._shared import scratch
from tandem.operators.random import bits_sql, uniform_sql
from tandem.plans import tables as X
from tandem.plans.registry import query

_L = f"WITH {X.LINKS} "
_LC = f"WITH {X.CELLS}, {X.LINKS} "
_V = f"WITH {X.VECTORS} "


def _texts(s, d):
    return X.table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("doc_name"))


def _images(s, d):
    """Two items for each label: an image name stands for several items."""
    return X.vectors(s, d).select("item_id", F.col("item_id").alias("doc_name"), "vec", "label")


@query(_L + "SELECT text_name AS left_id, image_name AS right_id FROM links")
def link_indexes(s, d):
    return J.link_indexes(_texts(s, d), _images(s, d), X.links(s, d)).select("left_id", "right_id")


@query(f"WITH {X.LINKS}, {X.VECTORS} SELECT text_name AS left_id, image_name AS right_id, 66 AS width, round(text_name + text_name % 7 + list_sum(vec), 4) AS total FROM links JOIN v ON item_id = image_name")
def flatten_pairs(s, d):
    doc = F.col("doc_id")
    texts = X.table(s, d, "documents").select(doc.alias("item_id"), F.array(doc.cast("double"), (doc % 7).cast("double")).alias("vec"))
    flat = J.flatten(texts, X.vectors(s, d), link_indexes(s, d))
    return flat.select("left_id", "right_id", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {X.VECTORS} SELECT item_id, label, round(vec[1], 6) AS x FROM v")
def zip_aligned(s, d):
    v = X.vectors(s, d)
    out = J.zip_aligned({"a": v.select("item_id", "label"), "b": v.select("item_id", F.round(F.col("vec")[0], 6).alias("x"))})
    return out.select("item_id", "a.label", "b.x")


@query(f"WITH {X.MATRIX} SELECT item_id, feature, value FROM m UNION ALL SELECT item_id, feature + 1000000, value * 2 FROM m")
def concat_cells(s, d):
    m = X.matrix(s, d)
    return J.concat_cells([m, m.withColumn("value", F.col("value") * 2)], [1_000_000, 1_000_000])


@query(_L + "SELECT text_name, count(*) AS n, min(image_name) AS first FROM links GROUP BY text_name")
def provenance(s, d):
    p = J.provenance(J.link_indexes(_texts(s, d), _images(s, d), X.links(s, d)))
    return p.groupBy("text_name").agg(F.count("*").alias("n"), F.min(F.struct("left_id", "right_id"))["right_id"].alias("first"))


@query(f"WITH {X.LINKS}, {X.VECTORS} SELECT text_name AS left_id, image_name AS right_id, 64 AS n_x, 1 AS n_y FROM links JOIN v ON item_id = image_name")
def align_by_links(s, d):
    texts = X.table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.array(F.col("doc_id").cast("double")).alias("vec"))
    out = J.align_by_links(texts, X.vectors(s, d), link_indexes(s, d), mode=2)
    return out.select("left_id", "right_id", F.size("x").alias("n_x"), F.size("y").alias("n_y"))


@query(_L + "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT image_name FROM links)")
def filter_by_links(s, d):
    links = X.links(s, d).withColumnRenamed("image_name", "vec_id")
    return J.filter_by_links(X.table(s, d, "embeddings").select("vec_id", "label"), links, "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def exclude_names(s, d):
    names = X.table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return J.exclude_names(X.table(s, d, "embeddings").select("vec_id", "label"), names, "vec_id")


@query(_L + "SELECT text_name, image_name // 2 AS image_name FROM links")
def rename_targets(s, d):
    ids = X.table(s, d, "embeddings").select(F.col("vec_id").alias("image_name"), F.floor(F.col("vec_id") / 2).alias("representative"))
    return J.rename_targets(X.links(s, d), ids)


@query(_LC + "SELECT feature AS word, count(DISTINCT image_name) AS n, min(image_name) AS first FROM cells JOIN links ON item_id = text_name GROUP BY feature")
def word_targets(s, d):
    w = J.word_to_targets(X.cells(s, d), _texts(s, d), X.links(s, d))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.min("image_name").alias("first"))


@query(_LC + "SELECT feature AS word, image_name, sum(value) AS freq FROM cells JOIN links ON item_id = text_name GROUP BY ALL")
def word_target_counts(s, d):
    return J.word_target_counts(X.cells(s, d), _texts(s, d), X.links(s, d))


_VOTE = _LC + ", t AS (SELECT DISTINCT feature, image_name FROM cells JOIN links ON item_id = text_name) SELECT item_id, image_name, {} AS score FROM cells JOIN t USING (feature) WHERE item_id % 20 = 0 GROUP BY item_id, image_name"


def _voted(s, d, mode):
    """A search: the queries are the items whose id is divisible by 20; all words and images of all documents take part."""
    asked = X.cells(s, d, X.table(s, d, "documents").where("doc_id % 20 = 0"))
    return J.votes(asked, X.cells(s, d), _texts(s, d), X.links(s, d), mode)


query(_VOTE.format("CAST(count(*) AS DOUBLE)"), "vote_hard")(lambda s, d: _voted(s, d, "hard"))
query(_VOTE.format("sum(value)"), "vote_soft")(lambda s, d: _voted(s, d, "soft"))


@query(f"WITH {X.CELLS} SELECT feature AS token, count(*) AS n, min(item_id) AS first FROM cells GROUP BY feature")
def token_positions(s, d):
    return J.token_positions(X.tokens(s, d)).groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"WITH {X.ANNOTATIONS} SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON x.text = y.text AND x.id <> y.id")
def intersect_pairs(s, d):
    a = X.annotations(s, d).select("id", "text")
    return J.intersect_pairs(a, a, "text").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query(f"WITH {X.ANNOTATIONS}, u AS (SELECT text, max(id) AS id, arg_max(time, id) AS time FROM a GROUP BY text), b AS (SELECT text, arg_max(label, id) AS label FROM a GROUP BY text) SELECT text, id, time, label FROM u JOIN b USING (text)")
def inner_join_by(s, d):
    a = X.annotations(s, d)
    left, right = a.select("text", "id", "time"), a.select("text", "label", F.col("id").alias("id"))
    return J.inner_join_by(left, right, "text", "id").select("text", "id", "time", "label")


_COS = "round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), {})"
_TOPK = _V + f", s AS (SELECT a.item_id AS query_id, b.item_id AS target_id, {_COS.format(4)} AS sim FROM v a, v b WHERE a.item_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, target_id) AS rank FROM s) "


def _hits(s, d, k=10):
    v = X.vectors(s, d).select("item_id", "vec")
    return R.similarity_topk_dense(v.where("item_id % 20 = 0"), v, k, digits=4)


@query(_TOPK + "SELECT query_id, target_id, sim, rank FROM r WHERE rank <= 10")
def sim_topk_dense(s, d):
    return _hits(s, d).select("query_id", "target_id", "sim", "rank")


_SPARSE = f"WITH {X.MATRIX}, u AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM m), s AS (SELECT a.item_id AS query_id, b.item_id AS target_id, round(sum(a.value * b.value), 4) AS sim FROM u a JOIN u b USING (feature) WHERE a.item_id % 20 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, target_id) AS rank FROM s) "


@query(_SPARSE + "SELECT query_id, target_id, sim, rank FROM r WHERE rank <= 5")
def sim_topk_sparse(s, d):
    u = R.normalized(X.matrix(s, d))
    return R.similarity_topk_sparse(u.where("item_id % 20 = 0"), u, 5, digits=4).select("query_id", "target_id", "sim", "rank")


@query(f"WITH {X.TFIDF}, s AS (SELECT a.item_id AS query_id, b.item_id AS target_id, round(sum(a.value * b.value), 4) AS sim FROM tfidf a JOIN tfidf b USING (feature) WHERE a.item_id % 20 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, target_id) AS rank FROM s) SELECT query_id, target_id, sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def sim_topk_words(s, d):
    """Bags of words, whose frequent words nearly every document has."""
    return R.similarity_topk_words(X.cells(s, d), "item_id % 20 = 0", X.table(s, d, "documents").count(), 5, digits=4).select("query_id", "target_id", "sim", "rank")


@query(_V + f", s AS (SELECT b.item_id, {_COS.format(6)} AS sim FROM v a, v b WHERE a.item_id = 7) SELECT item_id, sim FROM s WHERE sim < 0.9999 ORDER BY sim DESC, item_id LIMIT 10")
def most_similar(s, d):
    v = X.vectors(s, d)
    q = v.where("item_id = 7").select("vec").first()[0]
    return R.most_similar_items(F.array(*[F.lit(x) for x in q]), v, limit=10**9)


@query(_TOPK + ", t AS (SELECT query_id, target_id FROM r WHERE rank <= 10), k AS (SELECT item_id AS target_id, (item_id * 3) // 20 * 20 % ((SELECT count(*) FROM v) // 20 * 20) AS image_id FROM v), z AS (SELECT t.query_id, h.target_id, round(sum(h.sim), 4) AS sim FROM t JOIN k USING (target_id) JOIN r h ON h.query_id = k.image_id AND h.rank <= 10 GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, target_id) AS rank FROM z) SELECT query_id, target_id, sim, rank FROM f WHERE rank <= 5")
def transfer_retrieval(s, d):
    v = X.vectors(s, d)
    n = v.count() // 20 * 20
    hits = _hits(s, d)
    links = v.select(F.col("item_id").alias("target_id"), (F.floor(F.col("item_id") * 3 / 20) * 20 % n).alias("image_id"))
    image_hits = hits.select(F.col("query_id").alias("image_id"), F.col("target_id").alias("similar_id"), "sim")
    out = R.transfer_retrieval(hits, links, image_hits, k=None)
    return R.ranked(out.drop("rank"), 5, digits=4).select("query_id", "target_id", "sim", "rank")


@query(_TOPK + ", z AS (SELECT query_id // 100 AS query_id, target_id, round(sum(sim), 4) AS sim FROM r WHERE rank <= 10 GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, target_id) AS rank FROM z) SELECT query_id, target_id, sim, rank FROM f WHERE rank <= 5")
def token_retrieval(s, d):
    items = X.vectors(s, d).select("item_id", F.floor(F.col("item_id") / 100).alias("doc_name"))
    out = R.token_retrieval(_hits(s, d), items, k=None)
    return R.ranked(out.drop("rank"), 5, digits=4).select("query_id", "target_id", "sim", "rank")


@query(_TOPK + "SELECT query_id, round(avg(sim), 6) AS avg_sim FROM r WHERE rank <= 10 GROUP BY query_id")
def average_similarity(s, d):
    return R.average_similarity(_hits(s, d)).withColumn("avg_sim", F.round("avg_sim", 6))


@query(_TOPK + ", p AS (SELECT query_id AS text, v.label AS image FROM r JOIN v ON v.item_id = target_id WHERE rank BETWEEN 2 AND 4), t AS (SELECT item_id AS text, label AS image FROM v), h AS (SELECT p.text, max(CASE WHEN p.image = t.image THEN 1.0 ELSE 0 END) AS hit FROM p JOIN t USING (text) GROUP BY p.text) SELECT round(avg(hit), 6) AS hit_rate, count(*) AS n_texts FROM h")
def evaluate_hit(s, d):
    v = X.vectors(s, d)
    true = v.select(F.col("item_id").alias("text"), F.col("label").alias("image"))
    found = _hits(s, d).where("rank BETWEEN 2 AND 4").join(v.select(F.col("item_id").alias("target_id"), F.col("label").alias("image")), "target_id")
    return R.evaluate_hit(true, found.select(F.col("query_id").alias("text"), "image")).withColumn("hit_rate", F.round("hit_rate", 6))


@query(_V + f", f AS (SELECT min(item_id) AS item_id, vec FROM v WHERE list_dot_product(vec, vec) > 0 GROUP BY vec), s AS (SELECT a.item_id AS a, b.item_id AS b, {_COS.format(4)} AS sim FROM f a JOIN f b ON a.item_id < b.item_id) SELECT a, b, sim FROM s WHERE sim >= 0.3")
def dup_pairs(s, d):
    """All pairs of different vectors; equal vectors are one item, the one with the least id."""
    v = X.vectors(s, d).where(F.exists("vec", lambda x: x != 0))
    firsts = v.groupBy("vec").agg(F.min("item_id").alias("item_id")).select("item_id", "vec")
    return R.duplicate_pairs(R.similar_pairs(firsts, 0.3, digits=4), same=0.3, once=True)


@query(_TOPK + ", q AS (SELECT *, max(rank) OVER (PARTITION BY query_id) AS n FROM r) SELECT query_id, target_id, sim, rank FROM q WHERE rank <= 5 OR ((n - rank) % greatest((n - 6) // 4, 1) = 0 AND (n - rank) // greatest((n - 6) // 4, 1) < 4)")
def sim_buckets(s, d):
    v = X.vectors(s, d).select("item_id", "vec")
    return R.similarity_buckets(v.where("item_id % 20 = 0"), v, 5, 4, digits=4).select("query_id", "target_id", "sim", F.col("rank").cast("int").alias("rank"))


@query(_TOPK + "SELECT query_id, CAST(least(floor((sim + 1) / 2 * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM r GROUP BY ALL")
def similarity_distribution(s, d):
    v = X.vectors(s, d).select("item_id", "vec")
    return R.similarity_distribution(v.where("item_id % 20 = 0"), v, digits=4)


_HALF = "h AS (SELECT item_id, vec[1:32] AS vec FROM v), " + f"s2 AS (SELECT a.item_id AS query_id, b.item_id AS target_id, {_COS.format(4)} AS sim FROM h a, h b WHERE a.item_id % 20 = 0), r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, target_id) AS rank FROM s2) "


@query(_TOPK + ", " + _HALF + "SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.target_id AS target_a, r.sim AS sim_a, r2.target_id AS target_b, r2.sim AS sim_b FROM r JOIN r2 USING (query_id, rank) WHERE r.rank BETWEEN 2 AND 10")
def compare_indexes(s, d):
    v = X.vectors(s, d)
    half = v.select("item_id", F.slice("vec", 1, 32).alias("vec"))
    other = R.similarity_topk_dense(half.where("item_id % 20 = 0"), half, 10, digits=4)
    return R.compare_indexes(_hits(s, d), other)


def _copies(s, d):
    """Four items of each vector, more and more bent: their cosines with the first are about 0.99, 0.97 and 0.94."""
    v = X.vectors(s, d).withColumn("c", F.explode(F.array(*map(F.lit, range(4)))))
    bent = F.transform("vec", lambda x, j: x * (1 + F.lit(0.15) * F.col("c") * ((j + F.col("item_id")) % 3 - 1)))
    return v.withColumn("vec", bent).select((F.col("item_id") * 4 + F.col("c")).alias("item_id"), "vec")


def _family(item):
    """Ids of two families, as from two sources."""
    return item % 2 == 0


def _scan(vectors: str, least: str) -> str:
    """SQL: the scan in id order over `vectors`; only items with a smaller neighbour can be taken, so only these are visited."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED ({vectors}),
p AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b FROM v a JOIN v b ON a.item_id < b.item_id WHERE {_COS.format(4)} >= {least}),
n AS MATERIALIZED (SELECT b AS item, list(a) AS smaller, row_number() OVER (ORDER BY b) AS k FROM p GROUP BY b),
scan AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken
    UNION ALL SELECT n.k, CASE WHEN len(list_filter(smaller, lambda x: NOT list_contains(taken, x))) > 0 THEN list_append(taken, item) ELSE taken END
    FROM scan JOIN n ON n.k = scan.k + 1),
gone AS (SELECT unnest(arg_max(taken, k)) AS item FROM scan),
classes AS (SELECT item_id, coalesce(min(a), item_id) AS representative FROM v LEFT JOIN (SELECT a, b FROM p WHERE a NOT IN (SELECT item FROM gone) AND b IN (SELECT item FROM gone)) ON b = item_id GROUP BY item_id)
"""


_SCAN = _scan("SELECT vec_id * 4 + c AS item_id, list_transform(embedding, lambda x, j: CAST(x AS DOUBLE) * (1 + 0.15::DOUBLE * c * ((j - 1 + vec_id) % 3 - 1))) AS vec FROM embeddings, (SELECT unnest(range(4)) AS c)", "CASE WHEN a.item_id % 2 = b.item_id % 2 THEN 0.98 ELSE 0.9 END")
_PREFER = "SELECT item_id, min(CASE WHEN item_id % 2 = 0 THEN 1000000000 ELSE 0 END + item_id) OVER (PARTITION BY representative) % 1000000000 AS representative FROM classes"


def _classes(s, d):
    return R.duplicates_of_vectors(_copies(s, d), 0.98, scratch(s, "duplicates"), digits=4, cross=0.9, family=_family)


@query(_scan("SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings", "0.3") + _PREFER)
def find_duplicates(s, d):
    classes = R.duplicates_of_vectors(X.vectors(s, d).select("item_id", "vec"), 0.3, scratch(s, "duplicates"), digits=4)
    return R.prefer_family(classes, F.col("item_id") % 2 == 0)


@query(_SCAN + "SELECT item_id, representative FROM classes")
def duplicate_classes(s, d):
    """0.98 inside a family of ids, 0.9 across."""
    return _classes(s, d)


@query(_SCAN + _PREFER)
def prefer_family(s, d):
    """A class of even ids only keeps its first, any other takes its first odd id."""
    return R.prefer_family(_classes(s, d), _family(F.col("item_id")))


_OFFERED = _TOPK + f""", n AS (SELECT *, max(rank) OVER (PARTITION BY query_id) AS n, CASE WHEN {uniform_sql('query_id', seed=4)} >= 0.5 THEN 1 ELSE 0 END AS skip FROM r),
o AS (SELECT query_id, target_id, rank FROM (SELECT *, n - rank AS back, greatest((n - skip - 6) // 6, 1) AS step FROM n)
      WHERE rank - skip >= 1 AND (rank - skip <= 6 OR (back % step = 0 AND back // step < 6))),
t AS (SELECT *, false AS duplicate FROM o UNION ALL SELECT *, true AS duplicate FROM o WHERE {uniform_sql('query_id', seed=5)} < 0.25)
SELECT query_id, duplicate, CAST(row_number() OVER (PARTITION BY query_id, duplicate ORDER BY {bits_sql('target_id', 'CAST(duplicate AS INTEGER)', seed=6)}, target_id) AS INTEGER) AS place, target_id, CAST(rank AS INTEGER) AS rank FROM t
"""


@query(_OFFERED)
def annotation_candidates(s, d):
    v = X.vectors(s, d).select("item_id", "vec")
    return R.annotation_candidates(v.where("item_id % 20 = 0"), v, seed=4, digits=4).withColumn("rank", F.col("rank").cast("int"))


_A = f"WITH {X.ANNOTATIONS} "


@query(_A + "SELECT \"user\", count(*) AS items, avg(len(images)) AS images_per_item, CAST(sum(len(appropriate)) AS BIGINT) AS appropriate, CAST(sum(len(inappropriate)) AS BIGINT) AS inappropriate, round(avg(len(appropriate)), 6) AS avg_appropriate, round(avg(len(inappropriate)), 6) AS avg_inappropriate FROM a GROUP BY ROLLUP (\"user\")")
def agree_totals(s, d):
    return A.totals(X.annotations(s, d), "user").withColumns({c: F.round(c, 6) for c in ("avg_appropriate", "avg_inappropriate")})


@query(_A + "SELECT id, len(appropriate) AS n_appropriate, len(list_filter(images, lambda x: NOT list_contains(list_concat(appropriate, inappropriate), x))) AS n_unannotated FROM a WHERE label IN ('l0', 'l1') AND len(inappropriate) < 3")
def annotation_columns(s, d):
    a = A.filter_suspicious(A.filter_labels(A.unannotated(A.combined(X.annotations(s, d))), ["l0", "l1"]), 3)
    return A.counts_by_len(a, "appropriate").select("id", F.col("n_appropriate").cast("long").alias("n_appropriate"), F.size("unannotated").cast("long").alias("n_unannotated"))


@query(_A + "SELECT count(*) AS rows, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS dropped FROM (SELECT label IN ('l0', 'l1') AND len(inappropriate) < 3 AS k FROM a)")
def filter_report(s, d):
    return A.filter_report(X.annotations(s, d), ["l0", "l1"], 3)


_HIT = "len(list_filter({0}, lambda x: list_contains({1}, x)))"
_MP = f"CASE WHEN len({{0}}) = 0 OR len({{1}}) = 0 THEN 0.5 ELSE ({_HIT} / len({{0}}) + {_HIT.replace('{0}', '{X}').replace('{1}', '{0}').replace('{X}', '{1}')} / len({{1}})) / 2 END"


@query(_A + "SELECT id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p = 0 OR r = 0 THEN 0 ELSE 2 * p * r / (0.5 * r + 1.5 * p) END, 6) AS f FROM (SELECT id, CASE WHEN len(appropriate) = 0 THEN 1.0 ELSE " + _HIT.format("appropriate", "t") + " / len(appropriate) END AS p, CASE WHEN len(t) = 0 THEN 1.0 ELSE " + _HIT.format("appropriate", "t") + " / len(t) END AS r FROM (SELECT *, images[1:4] AS t FROM a))")
def precision_recall(s, d):
    t = F.slice("images", 1, 4)
    p = F.col("appropriate")
    return X.annotations(s, d).select("id", F.round(A.precision(p, t), 6).alias("p"), F.round(A.recall(p, t), 6).alias("r"), F.round(A.f_score(p, t, 1.5, 0.5), 6).alias("f"))


@query(_A + "SELECT id, round(CASE WHEN c = 1 THEN 1.0 ELSE (o - c) / (1 - c) END, 6) AS kappa FROM (SELECT id, (i + 12 - (x + y - i)) / 12.0 AS o, x / 12.0 * y / 12.0 + (1 - x / 12.0) * (1 - y / 12.0) AS c FROM (SELECT id, " + _HIT.format("appropriate", "t") + " AS i, len(appropriate) AS x, 4 AS y FROM (SELECT *, images[1:4] AS t FROM a)))")
def kappa(s, d):
    return X.annotations(s, d).select("id", F.round(A.kappa(F.col("appropriate"), F.slice("images", 1, 4), 12, "cohen"), 6).alias("kappa"))


@query(_A + "SELECT id, round(CASE WHEN c = 1 THEN 0.0 ELSE (o - c) / (1 - c) END, 6) AS kappa FROM (SELECT id, (i + 12 - (x + y - i)) / 24.0 AS o, x / 12.0 * y / 12.0 + (1 - x / 12.0) * (1 - y / 12.0) AS c FROM (SELECT id, " + _HIT.format("appropriate", "t") + " AS i, len(appropriate) AS x, 4 AS y FROM (SELECT *, images[1:4] AS t FROM a)))")
def kappa_reference(s, d):
    return X.annotations(s, d).select("id", F.round(A.kappa(F.col("appropriate"), F.slice("images", 1, 4)), 6).alias("kappa"))


_PAIR = "FROM a x JOIN a y ON x.text = y.text AND "


@query(_A + f"SELECT x.text, round(avg({_MP.format('x.appropriate', 'y.appropriate')}), 6) AS agreement, count(*) AS pairs {_PAIR} x.id < y.id GROUP BY x.text")
def mutual_precision(s, d):
    out = A.group_mutual_precision(X.annotations(s, d), "appropriate")
    return out.select("text", F.round("agreement", 6).alias("agreement"), "pairs")


_GRID = _A + f", g AS (SELECT x.\"user\" AS u1, y.\"user\" AS u2, avg({_MP.format('x.appropriate', 'y.appropriate')}) AS value, count(*) AS pairs, CAST(sum(len(x.appropriate)) AS BIGINT) AS size1, CAST(sum(len(y.appropriate)) AS BIGINT) AS size2 {_PAIR} x.id <> y.id WHERE x.\"user\" <> y.\"user\" GROUP BY ALL), us AS (SELECT u1 AS \"user\", round(avg(value), 6) AS mean, sum(value * pairs) / sum(pairs) AS weighted, CAST(sum(pairs) AS BIGINT) AS pairs FROM g GROUP BY u1) "


def _grid(s, d, column="appropriate"):
    return A.agreement_grid(X.annotations(s, d), column, A.mutual_precision)


@query(_GRID + "SELECT u1, u2, round(value, 6) AS value, pairs, size1, size2 FROM g")
def agree_grid(s, d):
    return _grid(s, d).withColumn("value", F.round("value", 6))


@query(_GRID + "SELECT round(avg(mean), 5) AS mean, round(sum(mean * pairs) / sum(pairs), 5) AS weighted, min(mean) AS min, max(mean) AS max, list_sort(list(mean))[count(*) // 2 + 2] AS pivot FROM us")
def agree_summary(s, d):
    out = A.agreement_summary(_grid(s, d))
    return out.select(F.round("mean", 5).alias("mean"), F.round("weighted", 5).alias("weighted"), "min", "max", "pivot")


@query(_A + "SELECT \"user\", count(*) AS items, count(*) FILTER (len(appropriate) + len(inappropriate) >= 5) AS suspicious, round(avg(CASE WHEN len(appropriate) + len(inappropriate) >= 5 THEN 1.0 ELSE 0 END), 6) AS share FROM a GROUP BY \"user\"")
def suspicious_report(s, d):
    return A.suspicious_report(X.annotations(s, d), 5).withColumn("share", F.round("share", 6))


@query(_A + ", b AS (SELECT \"user\", min(time) - 1 AS start FROM a GROUP BY \"user\") SELECT \"user\", CAST(count(DISTINCT floor((time - start) / 60)) AS DOUBLE) AS time_reward FROM a JOIN b USING (\"user\") GROUP BY \"user\"")
def time_reward(s, d):
    return A.time_reward(X.annotations(s, d))


def _means(g, c):
    """SQL: each user's mean agreement on a column and the pivot."""
    mean = f"SELECT x.\"user\" AS u1, avg({_MP.format(f'x.{c}', f'y.{c}')}) AS value {_PAIR} x.id <> y.id WHERE x.\"user\" <> y.\"user\" GROUP BY x.\"user\", y.\"user\""
    return f", u{g} AS (SELECT u1 AS \"user\", round(avg(value), 6) AS mean{g} FROM ({mean}) GROUP BY u1), p{g} AS (SELECT list_sort(list(mean{g}))[count(*) // 2 + 2] AS pivot{g} FROM u{g})"


_REWARDS = _A + _means("a", "appropriate") + _means("i", "inappropriate") + (
    ", c AS (SELECT \"user\", list_concat(appropriate, inappropriate) AS c, len(appropriate) AS n, coalesce(meana / pivota, 0) AS ca, coalesce(meani / pivoti, 0) AS ci FROM a LEFT JOIN ua USING (\"user\") LEFT JOIN ui USING (\"user\"), pa, pi)"
    ", i AS (SELECT \"user\", sum(coalesce(list_sum(list_transform(range(1, least(7, len(c)) + 1), lambda k: [1.0, 0.5, 0.5, 0.25, 0.25, 0.25, 0.25][k] * CASE WHEN k <= n THEN ca ELSE ci END)), 0)) AS item_reward FROM c GROUP BY \"user\")"
    ", b AS (SELECT \"user\", min(time) - 1 AS start FROM a GROUP BY \"user\"), t AS (SELECT \"user\", CAST(count(DISTINCT floor((time - start) / 60)) AS DOUBLE) AS time_reward FROM a JOIN b USING (\"user\") GROUP BY \"user\") "
)


def _rewards(s, d):
    return A.rewards(X.annotations(s, d), _grid(s, d), _grid(s, d, "inappropriate"))


@query(_REWARDS + "SELECT \"user\", round(item_reward, 3) AS item_reward, time_reward, round(item_reward + time_reward, 3) AS total FROM i JOIN t USING (\"user\")")
def rewards(s, d):
    return _rewards(s, d).withColumns({c: F.round(c, 3) for c in ("item_reward", "total")})


@query(_REWARDS + "SELECT count(*) AS users, sum(time_reward) AS time_reward, round(sum(item_reward), 2) AS item_reward, round(sum(item_reward + time_reward), 2) AS total FROM i JOIN t USING (\"user\")")
def reward_totals(s, d):
    return A.reward_totals(_rewards(s, d)).withColumns({c: F.round(c, 2) for c in ("item_reward", "total")})


_ORIGINALS = _A + ", r AS (SELECT \"user\", list_contains(appropriate, 'i' || (text % 12)) AS hit, len(appropriate) AS n FROM a), o AS (SELECT \"user\", count(*) AS n, (1e-5 + count(*) FILTER (hit)) / (1e-5 + count(*)) AS r, (1e-5 + count(*) FILTER (hit)) / (1e-5 + sum(n)) AS p FROM r GROUP BY \"user\") "


@query(_ORIGINALS + "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(r * n) / sum(n), 6) AS recall, round(sum(p * n) / sum(n), 6) AS precision, round(sum(2 * p * r / (p + r) * n) / sum(n), 6) AS f FROM o")
def original_recall_means(s, d):
    a = X.annotations(s, d)
    originals = a.select("text").distinct().withColumn("original", F.concat(F.lit("i"), F.col("text") % 12))
    return A.recall_means(A.original_recall(a, originals)).withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f")})


@query(_A + ", r AS (SELECT \"user\", list_contains(appropriate, 'i' || (text % 12)) AS hit, len(appropriate) AS n FROM a) SELECT \"user\", count(*) AS n, round((1e-5 + count(*) FILTER (hit)) / (1e-5 + count(*)), 6) AS recall, round((1e-5 + count(*) FILTER (hit)) / (1e-5 + sum(n)), 6) AS precision FROM r GROUP BY \"user\"")
def original_recall(s, d):
    a = X.annotations(s, d)
    originals = a.select("text").distinct().withColumn("original", F.concat(F.lit("i"), F.col("text") % 12))
    return A.original_recall(a, originals).select("user", "n", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(_A + ", e AS (SELECT text, count(DISTINCT id) AS c, image FROM (SELECT text, id, unnest(appropriate) AS image FROM a) GROUP BY text, image), n AS (SELECT text, count(*) AS n FROM a GROUP BY text) SELECT n.text, count(image) AS n_shared, min(image) AS first FROM n LEFT JOIN e ON n.text = e.text AND c = n AND n >= 2 GROUP BY n.text")
def overlapping(s, d):
    return A.overlapping(X.annotations(s, d), "appropriate").select("text", F.size("shared").cast("long").alias("n_shared"), F.get("shared", F.lit(0)).alias("first"))


@query(_A + "SELECT DISTINCT text, image FROM (SELECT text, unnest(appropriate) AS image FROM a) WHERE image <> ''")
def export_links(s, d):
    return A.export_links(X.annotations(s, d))


@query(_A + "SELECT text, id, n FROM a JOIN (SELECT text, count(*) AS n FROM a GROUP BY text HAVING count(*) > 1) USING (text)")
def duplicate_texts(s, d):
    return A.duplicate_texts(X.annotations(s, d))


@query(_A + "SELECT min(time) AS first, max(time) AS last, strftime(make_timestamp(min(time) * 1000000), '%Y-%m-%d %H:%M:%S') AS first_text, strftime(make_timestamp(max(time) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_text FROM a")
def timeframe(s, d):
    return A.timeframe(X.annotations(s, d))


@query(_A + "SELECT \"user\", time, id, len(appropriate) AS value FROM a")
def column_over_time(s, d):
    a = X.annotations(s, d).withColumn("n", F.size("appropriate").cast("long"))
    return A.column_over_time(a, "n")


def _layer(kind="sigmoid"):
    """64 inputs, 8 units, weights by formula."""
    w = [[math.sin(i * 8 + j + 1) / 4 for j in range(8)] for i in range(64)]
    return L.layer(w, [math.cos(j) / 4 for j in range(8)], [math.sin(i) / 8 for i in range(64)], kind, "sigmoid")


_UP = _V + ", u AS (SELECT item_id, j, sum(vec[i + 1] * sin(i * 8 + j + 1) / 4) + any_value(cos(j) / 4) AS x FROM v, range(64) a(i), range(8) b(j) GROUP BY item_id, j), h AS (SELECT item_id, j, 1 / (1 + exp(-x)) AS h FROM u) "


@query(_UP + "SELECT item_id, CAST(j AS INTEGER) AS unit, round(h, 6) AS value FROM h")
def layer_forward(s, d):
    return L.layer_forward(X.vectors(s, d), _layer()).select("item_id", F.posexplode("vec").alias("unit", "value")).withColumn("value", F.round("value", 6))


_DOWN = _UP + ", r AS (SELECT item_id, i, 1 / (1 + exp(-(sum(h * sin(i * 8 + j + 1) / 4) + any_value(sin(i) / 8)))) AS x FROM h, range(64) a(i) GROUP BY item_id, i) "


@query(_DOWN + "SELECT item_id, CAST(i AS INTEGER) AS unit, round(x, 6) AS value FROM r")
def layer_backward(s, d):
    h = L.layer_forward(X.vectors(s, d), _layer())
    return L.layer_backward(h, _layer()).select("item_id", F.posexplode("vec").alias("unit", "value")).withColumn("value", F.round("value", 6))


@query(_DOWN + "SELECT item_id, round(avg((x - vec[i + 1]) ** 2), 6) AS error FROM r JOIN v USING (item_id) GROUP BY item_id")
def recon_error(s, d):
    return L.reconstruction_error(X.vectors(s, d), _layer()).withColumn("error", F.round("error", 6))


@query(_UP + ", k AS (SELECT j, avg(h) AS rho FROM h GROUP BY j) SELECT CAST(j AS INTEGER) AS unit, round(0.05 * ln(0.05 / rho) + 0.95 * ln(0.95 / (1 - rho)), 6) AS kl FROM k")
def sparsity_kl(s, d):
    return L.sparsity_kl(L.layer_forward(X.vectors(s, d), _layer())).select("unit", F.round("kl", 6).alias("kl"))


@query(_UP + ", e AS (SELECT item_id, -sum(ln(1 + exp(x))) AS e FROM u GROUP BY item_id), b AS (SELECT item_id, sum(vec[i + 1] * sin(i) / 8) AS b FROM v, range(64) a(i) GROUP BY item_id) SELECT item_id, round(e - b, 6) AS energy FROM e JOIN b USING (item_id)")
def free_energy(s, d):
    return L.free_energy(X.vectors(s, d), _layer()).withColumn("energy", F.round("energy", 6))


@query(_UP + "SELECT item_id, round(sum(-(h * ln(h) + (1 - h) * ln(1 - h))), 6) AS entropy FROM h GROUP BY item_id")
def activation_entropy(s, d):
    return L.activation_entropy(L.layer_forward(X.vectors(s, d), _layer())).withColumn("entropy", F.round("entropy", 6))


@query(_DOWN + "SELECT round(avg((x - vec[i + 1]) ** 2), 6) AS mse FROM r JOIN v USING (item_id)")
def regression_error(s, d):
    v = X.vectors(s, d)
    return L.regression_error(L.layer_backward(L.layer_forward(v, _layer()), _layer()), v).withColumn("mse", F.round("mse", 6))


@query(_DOWN + ", e AS (SELECT item_id, avg((x - vec[i + 1]) ** 2) AS loss FROM r JOIN v USING (item_id) GROUP BY item_id), b AS (SELECT item_id // 64 AS batch, avg(loss) AS loss FROM e WHERE item_id % 5 = 0 GROUP BY 1) SELECT round(avg(loss), 6) AS loss FROM b")
def evaluate_split(s, d):
    losses = L.reconstruction_error(X.vectors(s, d), _layer()).select(F.floor(F.col("item_id") / 64).alias("batch"), F.col("error").alias("loss"), F.when(F.col("item_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return L.evaluate_split(losses, "test").withColumn("loss", F.round("loss", 6))


@query(_V + ", w AS (SELECT label AS layer, abs(vec[i]) AS a FROM (SELECT label, vec, unnest(range(1, 65)) AS i FROM v)) SELECT CAST(layer AS VARCHAR) AS layer, round(sum(a), 4) AS l1, round(sum(a * a), 4) AS l2 FROM w GROUP BY layer")
def weight_norms(s, d):
    w = X.vectors(s, d).select(F.col("label").cast("string").alias("layer"), F.col("item_id").alias("i"), F.posexplode("vec").alias("j", "w"))
    return L.weight_norms(w).withColumns({c: F.round(c, 4) for c in ("l1", "l2")})


_ENERGY = "SELECT item_id, -sum(ln(1 + exp(z))) - any_value(b) AS e FROM (SELECT item_id, j, sum({0}[i + 1] * sin(i * 8 + j + 1) / 4) + any_value(cos(j) / 4) AS z, sum({0}[i + 1] * sin(i) / 8) AS b FROM x, range(64) a(i), range(8) b(j) GROUP BY item_id, j) GROUP BY item_id"


@query(_V + f", x AS (SELECT item_id, list_transform(vec, lambda y: round_even(y, 0)) AS x, list_transform(vec, lambda y, k: CASE WHEN k = 1 THEN 1 - round_even(y, 0) ELSE round_even(y, 0) END) AS y FROM v), ex AS ({_ENERGY.format('x')}), ey AS ({_ENERGY.format('y')}) SELECT item_id, round(-64 * ln(1 + exp(ex.e - ey.e)), 6) AS value FROM ex JOIN ey USING (item_id)")
def pseudo_likelihood(s, d):
    return L.pseudo_likelihood(X.vectors(s, d), _layer()).withColumn("value", F.round("value", 6))


def _up_sql(source: str, n_out: int, shift: int, activation: str) -> str:
    """Rows (item_id, i, value) through a layer whose weights are sin(i * n_out + j + shift) / 4."""
    z = f"sum(value * sin(i * {n_out} + j + {shift}) / 4) + any_value(cos(j) / 4)"
    out = {"sigmoid": f"1 / (1 + exp(-({z})))", "tanh": f"tanh({z})"}[activation]
    return f"SELECT item_id, j AS i, {out} AS value FROM {source}, range({n_out}) b(j) GROUP BY item_id, j"


def _down_sql(source: str, n_in: int, n_out: int, shift: int) -> str:
    return f"SELECT item_id, k AS i, 1 / (1 + exp(-(sum(value * sin(k * {n_out} + i + {shift}) / 4) + any_value(sin(k) / 8)))) AS value FROM {source}, range({n_in}) c(k) GROUP BY item_id, k"


def _complete_sql(text: str, dim_text: int, dim_img: int, units: int, shift: int, k: int, seed: int) -> tuple[str, str]:
    """CTEs of k clamped steps and the last one's name."""
    parts, image = [], f"(SELECT DISTINCT item_id, unnest(range({dim_text}, {dim_text + dim_img})) AS i, 0.0::DOUBLE AS value FROM {text})"
    for step in range(k):
        last = step == k - 1
        value = "value" if last else f"CASE WHEN {uniform_sql('item_id', 'i', seed=seed + 2 * step)} < value THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        parts.append(f"x{step} AS (SELECT item_id, i, value FROM {text} UNION ALL SELECT item_id, i, value FROM {image})")
        parts.append(f"u{step} AS MATERIALIZED ({_up_sql(f'x{step}', units, shift, 'sigmoid')})")
        parts.append(f"h{step} AS MATERIALIZED (SELECT item_id, i, {value} AS value FROM u{step})")
        parts.append(f"i{step} AS MATERIALIZED (SELECT * FROM ({_down_sql(f'h{step}', dim_text + dim_img, units, shift)}) WHERE i >= {dim_text})")
        image = f"i{step}"
    return ", ".join(parts), image


_CELLS40 = _V + ", t AS MATERIALIZED (SELECT item_id, unnest(range(40)) AS i, unnest(vec[1:40]) AS value FROM v), "
_STEPS, _IMAGE = _complete_sql("t", 40, 24, 8, 1, 5, 2)


@query(_CELLS40 + _STEPS + f" SELECT item_id, CAST(i - 40 AS INTEGER) AS unit, round(value, 6) AS value FROM {_IMAGE}")
def complete_modality(s, d):
    text = X.vectors(s, d).select("item_id", F.slice("vec", 1, 40).alias("vec"))
    out = L.complete_modality(text, _layer(), 40, 24, k=5, seed=2)
    return out.select("item_id", F.posexplode("vec").alias("unit", "value")).withColumn("value", F.round("value", 6))


def _formula(n_in: int, n_out: int, shift: int, activation: str = "sigmoid"):
    w = [[math.sin(i * n_out + j + shift) / 4 for j in range(n_out)] for i in range(n_in)]
    return L.layer(w, [math.cos(j) / 4 for j in range(n_out)], [math.sin(i) / 8 for i in range(n_in)], activation, "sigmoid")


_CELLS64 = _V + ", v0 AS (SELECT item_id, unnest(range(64)) AS i, unnest(vec) AS value FROM v), "
_STACK = f"t1 AS MATERIALIZED ({_up_sql('v0', 16, 3, 'sigmoid')}), t AS MATERIALIZED ({_up_sql('t1', 6, 5, 'tanh')})"
_STEPS2, _IMAGE2 = _complete_sql("t", 6, 6, 5, 7, 3, 9)


@query(_CELLS64 + _STACK + " SELECT item_id, CAST(i AS INTEGER) AS unit, round(value, 6) AS value FROM t")
def stack_forward(s, d):
    out = L.stack_forward(X.vectors(s, d), [_formula(64, 16, 3), _formula(16, 6, 5, "tanh")])
    return out.select("item_id", F.posexplode("vec").alias("unit", "value")).withColumn("value", F.round("value", 6))


@query(_CELLS64 + _STACK + ", " + _STEPS2 + f", m0 AS (SELECT item_id, i - 6 AS i, value FROM {_IMAGE2}), m1 AS MATERIALIZED ({_down_sql('m0', 16, 6, 5)}), m2 AS ({_down_sql('m1', 64, 16, 3)}) SELECT item_id, CAST(i AS INTEGER) AS unit, round(value, 6) AS value FROM m2")
def text_to_image(s, d):
    """Two layers up on the text side, the joint layer, and the mirrored two layers down on the image side."""
    side = [_formula(64, 16, 3), _formula(16, 6, 5, "tanh")]
    out = L.text_to_image(X.vectors(s, d), side, _formula(12, 5, 7), side, k=3, seed=9)
    return out.select("item_id", F.posexplode("vec").alias("unit", "value")).withColumn("value", F.round("value", 6))


@query("SELECT true AS optimal, count(*) FILTER (vec_id % 5 <> 0) AS rows, count(*) FILTER (vec_id % 5 = 0) AS held_out, true AS better FROM embeddings")
def softmax_classifier(s, d):
    """The fitted weights are the one optimum of the ridge objective: its gradient there is under 1e-4; and they explain the rows better than the labels' shares."""
    from tandem.operators import learn

    v = X.vectors(s, d)
    train, test = v.where("item_id % 5 <> 0"), v.where("item_id % 5 = 0")
    model = learn.softmax_classifier(train, 200, reg=0.01, tol=1e-10)
    found = learn.softmax_gradient(model, train, reg=0.01)
    scored = learn.evaluate(learn.predict(model, train)).select(F.col("nll").alias("nll"))
    held = learn.evaluate(learn.predict(model, test).withColumn("_n", F.lit(1))).select("error")
    n = test.agg(F.count("*").alias("held_out"))
    shares = train.groupBy("label").count().agg((F.sum("count") * F.log(F.sum("count")) - F.sum(F.col("count") * F.log("count"))).alias("x"), F.sum("count").alias("n")).select((F.col("x") / F.col("n")).alias("prior"))
    row = found.join(scored).join(n).join(shares).join(held)  # one row each
    return row.select((F.col("gradient") < 1e-4).alias("optimal"), "rows", "held_out", ((F.col("nll") < F.col("prior")) & F.col("error").between(0, 1)).alias("better"))


@query("SELECT count(*) FILTER (vec_id % 5 <> 0) AS rows, true AS better FROM embeddings")
def mlp_classifier(s, d):
    """A network explains the rows it was trained on better than the labels' shares do."""
    from tandem.operators import learn

    train = X.vectors(s, d).where("item_id % 5 <> 0")
    n = train.agg(F.max("label")).first()[0] + 1
    scored = learn.evaluate(learn.predict(learn.mlp_classifier(train, [64, 16, n], 60), train)).select("nll")
    shares = train.groupBy("label").count().agg((F.sum("count") * F.log(F.sum("count")) - F.sum(F.col("count") * F.log("count"))).alias("x"), F.sum("count").alias("n"))
    return scored.join(shares).select(F.col("n").alias("rows"), (F.col("nll") < F.col("x") / F.col("n")).alias("better"))  # one row each
