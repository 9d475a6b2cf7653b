"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.  DataFrame functions only.

The sets are those of the shingles of five words (letters and digits, lower case).  A long document and a short item
have a tiny Jaccard similarity even if the document holds the whole item, so the search is for containment.  Items are
partitioned by the size of their sets; an item of n shingles is represented by its n - ceil(0.8 n) + 1 smallest hash
values, so the sketches grow with the size class.  A document that holds 80 % of an item's shingles must hold one of
these, whatever they are, so the candidates lack no match.  A document's shingles are hashed once, and those that don't exceed
the largest bound of the size classes are looked up: a hash that equals a sketch's value names its item, whose size
class and bound it thereby fits.  Candidate pairs are then verified by counting the shingles, compared as text, that
they share.

The item side is broadcast only if its sketch rows have been counted and are at most `broadcast_rows`; otherwise both
lookups are shuffle joins.  So are the documents found, which are distinct pairs by then and written to be counted.

Scripts without spaces between words (Chinese, Japanese, Thai and others) are split into characters, each a word.  An
item of fewer than five words has one shingle, its whole sequence, which is looked up among the documents' runs of
that length under a bound of its own; `short` turns this on.  Texts without words match nothing.  Rows that share a
doc_id are judged each on its own; equal rows give one result row.  Repeated items match each on its own.  Empty tables
give no rows.  `contained` reads doc_id, item_id and text only; `clean` returns the documents' columns, whatever their
names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm._common import written

UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = r"[\p{L}\p{N}]+"
SPLIT_WORD = rf"[\p{{L}}\p{{N}}&&[{UNSPACED}]]|[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+"
#: Below these characters both find the same; SPLIT_WORD takes longer.
LATER = r"[\x{E00}-\x{10FFFF}]"


def words_of(text: Column) -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    found = [F.regexp_extract_all(text, F.lit(w), 0) for w in (SPLIT_WORD, WORD)]
    return F.when(F.rlike(text, F.lit(LATER)), found[0]).otherwise(found[1])


def _runs(array: Column, k: int, names: list[str]) -> Column:
    """Array of structs of k neighbours each (the last k-1 of them incomplete)."""
    parts = [F.slice(array, i + 1, F.greatest(F.size(array) - i, F.lit(0))).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*parts) if k > 1 else F.transform(array, lambda x: F.struct(x.alias(names[0])))


def shingles(table: DataFrame, keys: list[str], k: int, as_text: bool, whole: bool = False) -> DataFrame:
    """`keys` and each shingle's hash `h`, and its text `shingle` if asked for; repeats are kept. whole: only texts of k words."""
    names = [f"_w{i}" for i in range(k)]
    words = words_of(F.col("text"))
    source = words if as_text else F.transform(words, lambda w: F.xxhash64(w))
    runs = table.select(*keys, source.alias("_words")).where(F.size("_words") == k if whole else F.size("_words") >= k)
    runs = runs.select(*keys, F.inline(_runs(F.col("_words"), k, names))).where(F.col(names[-1]).isNotNull())
    if as_text:
        hashed = F.xxhash64(*[F.xxhash64(n) for n in names])
        return runs.select(*keys, hashed.alias("h"), F.concat_ws(" ", *names).alias("shingle"))
    return runs.select(*keys, F.xxhash64(*names).alias("h"))


def contained(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8, broadcast_rows: int = 1_000_000, short: bool = False) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, text_hash, item_id, n_item, n_shared, containment."""
    items = items.select("item_id", F.xxhash64("text").alias("item_hash"), "text")
    keys = ["item_id", "item_hash"]
    sets = shingles(items, keys, k, as_text=True).withColumn("k", F.lit(k))
    for n in range(1, k if short else 1):
        sets = sets.unionByName(shingles(items, keys, n, as_text=True, whole=True).withColumn("k", F.lit(n)))
    sets = sets.distinct()
    sizes = sets.groupBy(*keys).agg(F.count("*").alias("n_item"))
    least = F.ceil(F.lit(share) * F.col("n_item") - 1e-9)
    by_hash = Window.partitionBy(*keys).orderBy("h")
    sketch = (
        sets.join(sizes, keys)
        .withColumn("r", F.row_number().over(by_hash))
        .where(F.col("r") <= F.col("n_item") - least + 1)
        .withColumn("size_class", F.floor(F.log2("n_item")))
    )
    bounds = sketch.groupBy("k", "size_class").agg(F.max("h").alias("largest"), F.count("*").alias("n")).collect()  # one row for each k and power of two
    if not bounds:
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *[F.lit(None).cast(t).alias(c) for c, t in _RESULT]).limit(0)
    small = sum(r["n"] for r in bounds) * 6 <= broadcast_rows
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    largest = {n: max(r["largest"] for r in bounds if r["k"] == n) for n in sorted({r["k"] for r in bounds})}

    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    doc = ["doc_id", "text_hash"]

    def probed(n: int, bound: int) -> DataFrame:
        """The documents that share a sketch value with an item of shingles of n words, and the item."""
        own = shingles(docs, doc, n, as_text=False).where(F.col("h") <= bound)
        return own.join(near(sketch.where(F.col("k") == n).select("h", *keys)), "h").select(*doc, *keys)

    pairs = reduce(DataFrame.unionByName, [probed(n, bound) for n, bound in largest.items()]).distinct()
    pairs = written(pairs, "pairs")
    found = pairs.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct(*keys)).alias("asked"))
    found = F.broadcast(found) if pairs.count() <= broadcast_rows else found  # few documents, counted: the texts of the others aren't moved
    held = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    held = held.select(*doc, "text", "asked").dropDuplicates(doc)
    own = reduce(DataFrame.unionByName, [shingles(held, [*doc, "asked"], n, as_text=True) for n in largest])
    shared = own.join(near(sets), ["h", "shingle"]).where(F.array_contains("asked", F.struct(*keys)))
    counts = shared.groupBy(*doc, *keys).agg(F.count_distinct("shingle").alias("n_shared"))
    out = counts.join(near(sizes.withColumn("least", least)), keys).where(F.col("n_shared") >= F.col("least"))
    return out.select(*doc, "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


_RESULT = (("item_id", "bigint"), ("n_item", "bigint"), ("n_shared", "bigint"), ("containment", "double"))


def clean(docs: DataFrame, items: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """`docs` without the rows that hold an item, short ones too."""
    bad = contained(docs, items, **{"short": True, "broadcast_rows": broadcast_rows} | options).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    bad = written(bad, "leaks")
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"]).eqNullSafe(bad["_hash"])), "left_anti")
