"""Similarity, retrieval, evaluation and duplicates."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators import meet, packed, ranks, sparse_blocks, sparse_index, vector_blocks
from tandem.operators._shared import written
from tandem.operators.random import hash_order, hash_uniform
from tandem.operators.vector_blocks import unit


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(u: Column, v: Column) -> Column:
    """Null where a norm is 0."""
    norms = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norms > 0, dot(u, v) / norms)


def normalized(cells: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("item_id")))
    return cells.withColumn("value", F.col("value") / norm)


def ranked(pairs: DataFrame, k: int | None, digits: int = 6) -> DataFrame:
    """sim rounded, rank by it and the target's id; a row_number limit is applied before the shuffle too."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "target_id")
    out = pairs.withColumn("sim", F.round("sim", digits)).withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def similarity_topk_sparse(queries: DataFrame, database: DataFrame, k: int | None = 10, digits: int = 6) -> DataFrame:
    """Cosines of cells that share a feature; both sides have unit norm. Postings are read only as far as they matter, all of them if k is None."""
    sims = sparse_index.all_pairs(queries, database) if k is None else sparse_index.topk(queries, database, k, digits)
    return ranked(sims, k, digits)


def similarity_topk_words(cells: DataFrame, asked: str, n_items: int, k: int = 10, digits: int = 6, eps: float = 1e-12) -> DataFrame:
    """The k best by cosine of tf-idf weights, as `similarity_topk_sparse` gives them for `bow.tfidf`, of counted words.

    cells hold an item's rows together in one partition; asked is the condition on item_id of the queries.  Bags are
    packed and written once, and weights are made where two groups of them meet, from the words' frequencies: the
    driver broadcasts those of coded words, the others come with their bag.
    """
    known = packed.vocabulary(written(packed.frequencies(cells), "frequencies"))
    bags = written(packed.bags(cells, known).withColumn("bag", F.monotonically_increasing_id()), "bags")
    if known.whole:
        bags = bags.withColumn("df", F.expr("transform(f, x -> 0L)"))
    else:
        rest = bags.select("bag", F.posexplode("f").alias("at", "f")).withColumn("df", F.count("*").over(Window.partitionBy("f")))
        listed = rest.groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("at", "df"))).alias("df")).select("bag", F.col("df.df").alias("df"))
        bags = written(bags.join(listed, "bag", "left").withColumn("df", F.coalesce("df", F.array().cast("array<long>"))), "weighted-bags")
    table = bags.sparkSession.sparkContext.broadcast(np.log2(n_items / known.n))

    def weights(b):
        row, f, v = packed.cells_of(b, True)
        coded = f >= 0
        v[coded] *= table.value[f[coded]]
        v[~coded] *= np.log2(n_items / b.column("df").flatten().to_numpy())
        kept = np.abs(v) > eps
        row, f, v = row[kept], f[kept], v[kept]
        return row, f, v / np.sqrt(np.bincount(row, v * v, b.num_rows))[row]

    queries, database = (df.drop("bag").withColumnRenamed("item_id", "item") for df in (bags.where(asked), bags))
    size = F.length("c") + F.length("n") + F.size("f") * 24
    return ranked(sparse_blocks.products(queries, database, k, digits, (weights, weights), size), k, digits)


def similarity_topk_dense(queries: DataFrame, database: DataFrame, k: int = 10, digits: int = 6, block_rows: int = 8192) -> DataFrame:
    """Cosines of (item_id, vec): a task holds a group of queries and reads a part of the database past it, block_rows at once."""
    as_long = lambda df: df.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast("array<double>").alias("vec"))
    size = queries.agg(F.sum(F.size("vec").cast("long") * 8)).first()[0] or 0
    n_left = max(1, -(-size // meet.GROUP_BYTES))

    def hold(batches):
        ids = np.concatenate([b.column("item_id").to_numpy() for b in batches])
        return ids, unit(np.concatenate([vector_blocks._matrix(b.column("vec")) for b in batches])), np.full((len(ids), 1), -np.inf)

    def score(held, batch):
        qi, x, floor = held
        for at in range(0, batch.num_rows, block_rows):
            di = batch.column("item_id").slice(at, block_rows).to_numpy()
            y = unit(vector_blocks._matrix(batch.column("vec").slice(at, block_rows)))
            for i in range(0, len(x), 256):
                sims = x[i : i + 256] @ y.T
                if k <= len(di):  # what rounding may tie with the k-th stays
                    least = np.partition(sims, -k, axis=1)[:, -k][:, None] - 10.0**-digits
                    floor[i : i + 256] = np.maximum(floor[i : i + 256], least)
                r, c = np.divmod(np.flatnonzero(sims >= floor[i : i + 256]), len(di))
                s = np.round(sims[r, c], digits) + 0.0
                order = np.lexsort((di[c], -s, r))
                r, c, s = r[order], c[order], s[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                yield pa.RecordBatch.from_pydict({"query_id": qi[i + r[best]], "target_id": di[c[best]], "sim": s[best]})

    both = meet.dealt(as_long(queries), as_long(database), n_left, -(-meet.tasks(queries.sparkSession) // n_left))
    return ranked(both.mapInArrow(lambda frames: meet.against(frames, hold, score), "query_id long, target_id long, sim double"), k, digits)


def most_similar_items(query: Column, database: DataFrame, limit: int = 10_000, k: int = 10, selfsim: bool = False, names: DataFrame | None = None) -> DataFrame:
    """The k most similar of the items with ids under `limit`; names (item_id, name) collapses duplicates, last wins."""
    sims = database.where(F.col("item_id") < limit).select("item_id", F.round(cosine(query, F.col("vec")), 6).alias("sim"))
    sims = sims if selfsim else sims.where("sim < 0.9999")
    if names is not None:
        sims = sims.join(names, "item_id").groupBy("name").agg(F.max_by("sim", "item_id").alias("sim")).withColumnRenamed("name", "item_id")
    return sims.orderBy(F.desc("sim"), "item_id").limit(k)


def transfer_retrieval(text_hits: DataFrame, links: DataFrame, image_hits: DataFrame, k: int = 10) -> DataFrame:
    """Similar texts -> their images -> similar images, similarities summed by image.

    text_hits (query_id, target_id), links (target_id, image_id), image_hits (image_id, similar_id, sim).
    """
    seeds = text_hits.select("query_id", "target_id").join(links, "target_id").groupBy("query_id", "image_id").agg(F.count("*").alias("_times"))
    sums = seeds.join(image_hits, "image_id").groupBy("query_id", F.col("similar_id").alias("target_id")).agg(F.sum(F.col("sim") * F.col("_times")).alias("sim"))
    return ranked(sums, k)


def token_retrieval(hits: DataFrame, tokens: DataFrame, k: int = 10) -> DataFrame:
    """Similarities of a document's tokens summed: hits (query_id = token item), tokens (item_id, doc_name)."""
    named = hits.join(tokens.select(F.col("item_id").alias("query_id"), "doc_name"), "query_id")
    return ranked(named.groupBy(F.col("doc_name").alias("query_id"), "target_id").agg(F.sum("sim").alias("sim")), k)


def average_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id").agg(F.avg("sim").alias("avg_sim"))


def evaluate_hit(true: DataFrame, predicted: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """One row, hit_rate: the share of predicted texts with a correct image; true and predicted (text, image)."""
    known = true.select("text").distinct().withColumn("_known", F.lit(True))
    correct = true.select("text", "image").distinct().withColumn("_hit", F.lit(1.0))
    rows = predicted.join(known, "text", "left").join(correct, ["text", "image"], "left")
    if not ignore_missing:
        rows = rows.where(F.assert_true(F.col("_known").isNotNull(), F.lit("a text is missing from the truth")).isNull())
    per_text = rows.where("_known").groupBy("text").agg(F.max(F.coalesce("_hit", F.lit(0.0))).alias("hit"))
    return per_text.agg(F.avg("hit").alias("hit_rate"), F.count("*").alias("n_texts"))


def duplicate_pairs(hits: DataFrame, same: float = 0.98, cross: float = 0.9, family: Column | None = None, once: bool = False) -> DataFrame:
    """Pairs (a < b) at or over the threshold, which is lower between two families of ids; once: no pair is in `hits` twice."""
    hits = hits.where("query_id <> target_id").select(F.least("query_id", "target_id").alias("a"), F.greatest("query_id", "target_id").alias("b"), "sim")
    hits = hits if once else hits.distinct()
    if family is None:
        return hits.where(F.col("sim") >= same)
    return hits.where(F.col("sim") >= F.when(family, F.lit(same)).otherwise(F.lit(cross)))


def similar_pairs(items: DataFrame, least: float, digits: int = 6, block_rows: int = 1024) -> DataFrame:
    """All pairs (query_id < target_id) of (item_id, vec) whose rounded cosine is at least `least`: blocks that angles to pivots put too far apart don't meet."""
    blocks = vector_blocks.angle_blocks(items, block_rows=block_rows)
    return vector_blocks.pairs_of_blocks(blocks, vector_blocks.near_blocks(blocks, least - 0.6 * 10.0**-digits), least, digits)


def duplicates_of_vectors(
    items: DataFrame, same: float, path: str, digits: int = 6, cross: float | None = None, family: Callable[[Column], Column] | None = None, ahead: int = 8192
) -> DataFrame:
    """item_id and representative of all (item_id, vec), by every pair of them at or over its threshold (over 0).

    The threshold is `same`, or `cross` for two ids whose `family` differs.  Equal vectors of one family have the same
    neighbours and are linked with each other, so the least id of each stands for all in the scan.  Items without a
    vector, or with zeros only, have no cosine and represent themselves.

    The scan goes in id order, so its first `ahead` items are decided by themselves, and what their representatives
    absorb takes no part in the rest of it: with a low threshold that is nearly all, and few pairs are listed.
    """
    of = family or (lambda _: F.lit(0))
    cross = same if cross is None or family is None else cross
    has = F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    items = items.select("item_id", "vec", of(F.col("item_id")).alias("family"))
    spark = items.sparkSession
    firsts = items.where(has).groupBy("vec", "family").agg(F.min("item_id").alias("first"))
    firsts.write.parquet(f"{path}/firsts")
    firsts = spark.read.parquet(f"{path}/firsts")
    distinct = firsts.select(F.col("first").alias("item_id"), "vec", "family")

    def scanned(part: DataFrame, name: str) -> DataFrame:
        found = similar_pairs(part.select("item_id", "vec"), min(same, cross), digits)
        if same != cross:
            found = found.where(F.col("sim") >= F.when(of(F.col("query_id")) == of(F.col("target_id")), F.lit(same)).otherwise(F.lit(cross)))
        found.select(F.col("query_id").alias("a"), F.col("target_id").alias("b")).write.parquet(f"{path}/{name}-pairs")
        return find_duplicates(part.select("item_id"), spark.read.parquet(f"{path}/{name}-pairs"), f"{path}/{name}")

    last = distinct.select("item_id").orderBy("item_id").limit(ahead).agg(F.max("item_id"), F.count("*")).first()
    if last[1] < ahead:
        classes = scanned(distinct, "all")
    else:
        first = scanned(distinct.where(F.col("item_id") <= last[0]), "first")
        chosen = distinct.join(first.where("item_id = representative").select("item_id"), "item_id", "left_semi")
        later = distinct.where(F.col("item_id") > last[0])
        _absorbed(chosen, later, same, cross, digits).write.parquet(f"{path}/absorbed")
        gone = spark.read.parquet(f"{path}/absorbed")
        classes = first.unionByName(gone).unionByName(scanned(later.join(gone, "item_id", "left_anti"), "rest"))
    members = items.where(has).join(firsts, ["vec", "family"]).select("item_id", "first").join(classes.withColumnRenamed("item_id", "first"), "first")
    return members.select("item_id", "representative").unionByName(items.where(~has).select("item_id", F.col("item_id").alias("representative")))


def _absorbed(chosen: DataFrame, later: DataFrame, same: float, cross: float, digits: int, rows: int = 1024) -> DataFrame:
    """item_id and representative of the `later` items that one of the `chosen` (a bounded number) absorbs, the smallest of these."""
    coded = lambda df: df.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast("array<double>").alias("vec"), F.xxhash64("family").alias("family"))

    def read(b):
        return b.column("item_id").to_numpy(), unit(vector_blocks._matrix(b.column("vec"))), b.column("family").to_numpy()

    def hold(batches):
        ids, x, family = (np.concatenate(v) for v in zip(*map(read, batches), strict=True))
        return ids, x, family

    def absorb(held, batch):
        ids, x, family = held
        own, y, kind = read(batch)
        for at in range(0, len(own), rows):
            r, c, sims = vector_blocks.close(y[at : at + rows], x, min(same, cross), digits)
            r, c = (v[sims >= np.where(kind[r + at] == family[c], same, cross)] for v in (r, c))
            by = np.full(rows, np.iinfo(np.int64).max)
            np.minimum.at(by, r, ids[c])
            hit = np.unique(r)
            yield pa.RecordBatch.from_pydict({"item_id": own[at + hit], "representative": by[hit]})

    n = max(meet.tasks(later.sparkSession), -(-later.count() // 65_536))
    both = meet.dealt(coded(chosen), coded(later), 1, n).select("pair", "side", "item_id", "vec", "family")
    return both.mapInArrow(lambda frames: meet.against(frames, hold, absorb), "item_id long, representative long")


def find_duplicates(items: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """item_id and representative: the scan in id order, in parallel rounds until no item is open.

    Undecided items whose smaller neighbours are all absorbed become representatives and absorb their neighbours; an
    item that several absorb goes to the smallest.  `path` is a folder for the state of each round; each round decides
    the least open item at least.
    """
    spark = items.sparkSession
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    state = items.select("item_id", F.lit(None).cast("long").alias("representative"))
    for i in itertools.count():
        state.write.mode("overwrite").parquet(f"{path}/round-{i}")
        state = spark.read.parquet(f"{path}/round-{i}")
        open_ = state.where("representative IS NULL").select("item_id")
        if open_.isEmpty():
            break
        smaller = both.where("y < x").join(open_.withColumnRenamed("item_id", "y"), "y", "left_semi").select(F.col("x").alias("item_id"))
        new = open_.join(smaller, "item_id", "left_anti")
        taken = both.join(new.withColumnRenamed("item_id", "y"), "y", "left_semi").groupBy(F.col("x").alias("item_id")).agg(F.min("y").alias("_by"))
        chosen = new.select("item_id", F.col("item_id").alias("_self"))
        state = state.join(chosen, "item_id", "left").join(taken, "item_id", "left").select("item_id", F.coalesce("_self", F.least("representative", "_by")).alias("representative"))
    return state


def prefer_family(classes: DataFrame, in_family: Column) -> DataFrame:
    """Replace each representative by the first member outside the family, if there is one."""
    first = classes.groupBy("representative").agg(F.min(F.struct(in_family.cast("int").alias("own"), "item_id")).alias("_first"))
    return classes.join(first, "representative").select("item_id", F.col("_first.item_id").alias("representative"))


def apply_dedup(vectors: DataFrame, links: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of representatives only, and links (text_name, item_id) to them."""
    kept = vectors.join(classes.where("item_id = representative").select("item_id"), "item_id", "left_semi")
    new = links.join(classes, "item_id").select("text_name", F.col("representative").alias("item_id")).distinct()
    return kept, new


def _spread(queries: DataFrame, n: int, first: int, k: int, skip: Column) -> DataFrame:
    """query_id and rank: after `skip` places the `first` best of n, and k more at even steps counted from the end."""
    step = F.greatest(F.floor((F.lit(n) - skip - first) / k), F.lit(1))
    best = F.transform(F.sequence(F.lit(1), F.lit(max(first, 1))), lambda i: F.when(i <= first, i + skip))
    steps = F.transform(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)), lambda i: F.when((i < k) & (n - i * step > skip), n - i * step))
    ranks = F.array_distinct(F.concat(F.transform(best, lambda x: x.cast("long")), F.transform(steps, lambda x: x.cast("long"))))
    return queries.select(F.col("item_id").alias("query_id"), F.explode(ranks).alias("rank")).where(F.col("rank").between(1, n))


def annotation_candidates(
    queries: DataFrame, database: DataFrame, n_top: int = 6, n_total: int = 12, p_original: float = 0.5, p_duplicates: float = 0.25, seed: int = 0, digits: int = 6
) -> DataFrame:
    """Images of (item_id, vec) offered for each text: the best n_top (the best one itself kept with p_original), then uniform steps.

    Places are found without ranking the database; coins are hashes.  `duplicate` marks repeated tasks.
    """
    skip = (hash_uniform("item_id", seed=seed) >= p_original).cast("int")
    wanted = _spread(queries, database.count(), n_top, n_total - n_top, skip)
    offered = written(ranks.places(queries, database, wanted, digits), "offered").select("query_id", "target_id", "rank")
    tasks = offered.withColumn("duplicate", F.lit(False)).unionByName(offered.where(hash_uniform("query_id", seed=seed + 1) < p_duplicates).withColumn("duplicate", F.lit(True)))
    order = Window.partitionBy("query_id", "duplicate").orderBy(hash_order("target_id", F.col("duplicate").cast("int"), seed=seed + 2), "target_id")
    return tasks.withColumn("place", F.row_number().over(order)).select("query_id", "duplicate", "place", "target_id", "rank")


def similarity_buckets(queries: DataFrame, database: DataFrame, n: int, k: int, digits: int = 6) -> DataFrame:
    """query_id, target_id, sim and rank: of each query's ranking the top n, and k of the rest at even steps counted from the end."""
    size = database.count()
    step = max(1, (size - (n + 1)) // k)
    places = sorted({*range(1, min(n, size) + 1), *(size - j * step for j in range(k) if size - j * step > 0)})
    wanted = queries.select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.lit(p).cast("long") for p in places])).alias("rank"))
    return ranks.places(queries, database, wanted, digits)


def compare_indexes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rankings side by side, the first hit (the query itself) left out."""
    x = a.where("rank > 1").select("query_id", "rank", F.col("target_id").alias("target_a"), F.col("sim").alias("sim_a"))
    y = b.where("rank > 1").select("query_id", "rank", F.col("target_id").alias("target_b"), F.col("sim").alias("sim_b"))
    return x.join(y, ["query_id", "rank"])


def similarity_distribution(queries: DataFrame, database: DataFrame, bins: int = 100, digits: int = 6) -> DataFrame:
    """Histogram of the rounded similarities in -1 .. 1 for each query, counted by the task that holds it."""
    return ranks.histogram(queries, database, bins, digits)
