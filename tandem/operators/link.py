"""Pairing of collections by position and by many-to-many links (text_name, image_name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators import packed, sparse_blocks


def zip_aligned(sources: dict[str, DataFrame], key: str = "item_id", check: bool = True) -> DataFrame:
    """One struct for each source, joined by ordinal; different lengths are an error."""
    names = list(sources)
    if check and len({sources[n].count() for n in names}) > 1:
        raise ValueError("the collections have different lengths")
    out = None
    for n in names:
        own = sources[n].select(key, F.struct(*[c for c in sources[n].columns if c != key]).alias(n))
        out = own if out is None else out.join(own, key)
    return out


def link_indexes(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """left_id, right_id of all items on either side of each pair of names."""
    pairs = links.select("text_name", "image_name").distinct()
    a = left.select(F.col("item_id").alias("left_id"), F.col("doc_name").alias("text_name"))
    b = right.select(F.col("item_id").alias("right_id"), F.col("doc_name").alias("image_name"))
    return pairs.join(a, "text_name").join(b, "image_name")


def concat_vectors(vectors: list[Column]) -> Column:
    return F.concat(*vectors)


def concat_cells(tables: list[DataFrame], dims: list[int]) -> DataFrame:
    """Sparse concatenation: features shifted by the sizes before them."""
    out, base = None, 0
    for t, d in zip(tables, dims, strict=True):
        own = t.select("item_id", (F.col("feature") + base).alias("feature"), "value")
        out, base = own if out is None else out.unionByName(own), base + d
    return out


def flatten(left: DataFrame, right: DataFrame, indexes: DataFrame, structured: bool = False) -> DataFrame:
    """Vectors of both sides for each pair, concatenated or as a struct."""
    a = left.select(F.col("item_id").alias("left_id"), F.col("vec").alias("_a"))
    b = right.select(F.col("item_id").alias("right_id"), F.col("vec").alias("_b"))
    joined = indexes.select("left_id", "right_id").join(a, "left_id").join(b, "right_id")
    vec = F.struct(F.col("_a").alias("left"), F.col("_b").alias("right")) if structured else F.concat("_a", "_b")
    return joined.select("left_id", "right_id", vec.alias("vec"))


def provenance(pairs: DataFrame) -> DataFrame:
    """The distinct pairs that each text name is part of, a row each."""
    return pairs.select("text_name", "left_id", "right_id").distinct()


def component(zipped: DataFrame, name: str, key: str = "item_id") -> DataFrame:
    return zipped.select(key, f"{name}.*")


def align_by_links(texts: DataFrame, images: DataFrame, indexes: DataFrame, mode: int = 0) -> DataFrame:
    """x and y of each pair: both joined (0), text to image (1) or image to text (2)."""
    both = flatten(texts, images, indexes, structured=True)
    x, y = {
        0: (F.concat("vec.left", "vec.right"), F.lit(None).cast("array<double>")),
        1: (F.col("vec.left"), F.col("vec.right")),
        2: (F.col("vec.right"), F.col("vec.left")),
    }[mode]
    return both.select("left_id", "right_id", x.alias("x"), y.alias("y"))


def filter_by_links(table: DataFrame, links: DataFrame, on: str | list[str]) -> DataFrame:
    return table.join(links.select(on if isinstance(on, list) else [on]), on, "left_semi")


def rename_targets(links: DataFrame, id_map: DataFrame) -> DataFrame:
    """Images replaced by their representative (image_name, representative); an image without one is an error."""
    joined = links.join(id_map, "image_name", "left")
    checked = F.assert_true(F.col("representative").isNotNull(), F.lit("an image has no representative"))
    return joined.where(checked.isNull()).select("text_name", F.col("representative").alias("image_name"))


def include_names(table: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return table.join(names.select(on), on, "left_semi")


def exclude_names(table: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return table.join(names.select(on), on, "left_anti")


def inner_join_by(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each shared key; later rows (by `order`) overwrite earlier ones, and b's columns overwrite a's."""
    last = lambda t: t.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in t.columns if c != key])
    x, y = last(a), last(b)
    return x.drop(*[c for c in y.columns if c != key]).join(y, key)


def intersect_pairs(a: DataFrame, b: DataFrame, key: str, unique_key: str = "id") -> DataFrame:
    """All pairs with an equal key and different unique keys: structs a and b."""
    x = a.select(F.col(key).alias("_key"), F.struct("*").alias("a"))
    y = b.select(F.col(key).alias("_key"), F.struct("*").alias("b"))
    return x.join(y, "_key").where(F.col(f"a.{unique_key}") != F.col(f"b.{unique_key}")).select("a", "b")


def _linked(cells: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """Cells with the images of their item: names and links meet first, so the cells are joined once, by item."""
    images = names.select("item_id", F.col("doc_name").alias("text_name")).join(links, "text_name").select("item_id", "image_name")
    return cells.join(images, "item_id")


def word_to_targets(cells: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """word and image_name: the distinct images of each word, a row each, as a common word has many."""
    return _linked(cells, names, links).select(F.col("feature").alias("word"), "image_name").distinct()


def word_target_counts(cells: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """Summed frequency of each word with each image."""
    return _linked(cells, names, links).groupBy(F.col("feature").alias("word"), "image_name").agg(F.sum("value").alias("freq"))


def map_words_to_targets(cells: DataFrame, word_targets: DataFrame, mode: str = "soft") -> DataFrame:
    """Scores of images by votes of an item's words: one each (hard) or the cell's value (soft); word_targets (word, image_name).

    Nearly every item shares a word with every image, so groups of both are multiplied; there is no row for each vote.
    """
    vote = F.col("value") if mode == "soft" else F.lit(1.0)
    items = sparse_blocks.bags(cells, "item_id", "feature", vote)
    images = sparse_blocks.bags(word_targets, "image_name", "word", F.lit(1.0))
    scores = sparse_blocks.products(items, images)
    return scores.select(F.col("query_id").alias("item_id"), F.col("target_id").alias("image_name"), F.col("sim").alias("score"))


def votes(items: DataFrame, cells: DataFrame, names: DataFrame, links: DataFrame, mode: str = "soft") -> DataFrame:
    """Scores of `map_words_to_targets(items, word_to_targets(cells, names, links), mode)`, of counted words.

    items and cells hold an item's rows together in one partition.  Words that no item has take no part; documents and
    images are sent as packed bags, an image's being the union of those of its documents, without a row for each word.
    """
    known = packed.vocabulary(packed.frequencies(items))
    images = names.select("item_id", F.col("doc_name").alias("text_name")).join(links, "text_name").select("item_id", "image_name")
    shown = packed.union(packed.bags(cells, known).drop("n", "m").join(images, "item_id"), "image_name")
    asked, soft = packed.bags(items, known), mode == "soft"
    read = (lambda b: packed.cells_of(b, soft), lambda b: packed.cells_of(b, False))
    size = F.length("c") + F.length("n") + F.size("f") * 16
    scores = sparse_blocks.products(asked.withColumnRenamed("item_id", "item"), shown.withColumnRenamed("image_name", "item"), cells=read, size=size)
    return scores.select(F.col("query_id").alias("item_id"), F.col("target_id").alias("image_name"), F.col("sim").alias("score"))


def token_positions(tokens: DataFrame, item: str = "doc_id", token: str = "token") -> DataFrame:
    """The distinct items in which each token occurs, a row each."""
    return tokens.select(token, item).distinct()


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
