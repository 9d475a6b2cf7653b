"""The engine's tables, derived from the given Parquet tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.word_counts import counted


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sentences(spark, d, documents: DataFrame | None = None) -> DataFrame:
    return (documents or table(spark, d, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_no", "line"))


def tokens(spark, d, documents: DataFrame | None = None) -> DataFrame:
    words = sentences(spark, d, documents).select("doc_id", "sent_no", F.posexplode(F.split(F.translate("line", ".,", ""), " ")).alias("tok_no", "form"))
    n = F.length("form")
    tag = F.when(n >= 6, "N").when(n <= 2, "A").otherwise("V")
    return words.where("form <> ''").withColumns({"lemma": F.lower("form"), "tag": tag, "token": F.lower("form")})


def cells(spark, d, documents: DataFrame | None = None) -> DataFrame:
    """Texts are sent to their document's task, which counts their words: the same words as those of `tokens`, without a row for each."""
    texts = (documents or table(spark, d, "documents")).select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    line = F.lower(F.translate("text", "\n.,", " "))
    return counted(texts.select(F.col("doc_id").alias("item_id"), line.alias("line")), together=False).where("feature <> ''")


def matrix(spark, d) -> DataFrame:
    grouped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("feature"))
    return grouped.agg(F.sum("l_quantity").cast("double").alias("value"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def links(spark, d) -> DataFrame:
    n = table(spark, d, "embeddings").count()
    doc = F.col("doc_id")
    return table(spark, d, "documents").select(doc.alias("text_name"), F.explode(F.array(doc % n, (doc * 7 + 3) % n)).alias("image_name")).distinct()


def word_ids(spark, d, words: DataFrame | None = None) -> DataFrame:
    """word and vec_id: every word whose length isn't a multiple of five has a row chosen by its letters. words (word): those of the documents, if they are known."""
    words = cells(spark, d).select(F.col("feature").alias("word")) if words is None else words.select("word")
    key = ((F.length("word") * 13 + F.length(F.translate("word", "e", ""))) % table(spark, d, "embeddings").count()).cast("long")
    ids = table(spark, d, "embeddings").select("vec_id")
    return words.distinct().where("length(word) % 5 <> 0").withColumn("vec_id", key).join(ids, "vec_id").select("word", "vec_id")


def id_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def word_vectors(spark, d, words: DataFrame | None = None) -> DataFrame:
    """word and the vector of its `word_ids`."""
    return word_ids(spark, d, words).join(id_vectors(spark, d), "vec_id").select("word", "vec")


def annotations(spark, d) -> DataFrame:
    e = F.col("event_id")
    choose = lambda cond: F.transform(F.filter(F.sequence(F.lit(0), F.lit(11)), cond), lambda i: F.concat(F.lit("i"), i))
    return table(spark, d, "events").select(
        e.alias("id"), (F.col("user_id") % 20).alias("user"), F.unix_timestamp("ts").alias("time"), F.floor(e / 20).alias("text"), F.concat(F.lit("l"), e % 3).alias("label"),
        choose(lambda i: i >= 0).alias("images"), choose(lambda i: (e * (i + 1) + i) % 7 < 2).alias("appropriate"),
        choose(lambda i: ((e * (i + 2) + i) % 5 == 0) & ((e * (i + 1) + i) % 7 >= 2)).alias("inappropriate"),
    )


TOKENS = """
l AS (SELECT doc_id, unnest(range(len(a))) AS sent_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
w AS (SELECT doc_id, sent_no, unnest(range(len(a))) AS tok_no, unnest(a) AS form
      FROM (SELECT doc_id, sent_no, string_split(translate(line, '.,', ''), ' ') AS a FROM l)),
tokens AS (SELECT doc_id, sent_no, tok_no, form, lower(form) AS token,
             CASE WHEN length(form) >= 6 THEN 'N' WHEN length(form) <= 2 THEN 'A' ELSE 'V' END AS tag FROM w WHERE form <> '')"""
CELLS = TOKENS + """,
cells AS (SELECT doc_id AS item_id, token AS feature, CAST(count(*) AS DOUBLE) AS value FROM tokens GROUP BY ALL)"""
TFIDF = CELLS + """,
df AS (SELECT feature, count(*) AS df FROM cells GROUP BY ALL),
plain AS (SELECT item_id, feature, value * log2((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) AS value FROM cells JOIN df USING (feature)),
weighted AS (SELECT * FROM plain WHERE abs(value) > 1e-12),
tfidf AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM weighted)"""
MATRIX = "m AS (SELECT l_orderkey AS item_id, l_partkey AS feature, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"
LINKS = """
n AS (SELECT count(*) AS n FROM embeddings),
links AS (SELECT DISTINCT text_name, image_name FROM (SELECT doc_id AS text_name, unnest([doc_id % n, (doc_id * 7 + 3) % n]) AS image_name FROM documents, n))"""
VECTORS = "v AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"
WORD_VECTORS = CELLS + """,
wv AS (SELECT token AS word, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM (SELECT DISTINCT token FROM tokens WHERE length(token) % 5 <> 0)
       JOIN embeddings ON vec_id = (length(token) * 13 + length(translate(token, 'e', ''))) % (SELECT count(*) FROM embeddings))"""
ANNOTATIONS = """
a AS (SELECT event_id AS id, user_id % 20 AS "user", CAST(floor(epoch(ts)) AS BIGINT) AS time, event_id // 20 AS text, 'l' || (event_id % 3) AS label,
  list_transform(range(12), lambda i: 'i' || i) AS images,
  list_transform(list_filter(range(12), lambda i: (event_id * (i + 1) + i) % 7 < 2), lambda i: 'i' || i) AS appropriate,
  list_transform(list_filter(range(12), lambda i: (event_id * (i + 2) + i) % 5 = 0 AND (event_id * (i + 1) + i) % 7 >= 2), lambda i: 'i' || i) AS inappropriate
  FROM events)"""
