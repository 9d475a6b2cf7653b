"""Queries of the text-file sources and sinks: each writes files from the given tables and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators import agree as A
from tandem.operators import bow as B
from tandem.operators import items as D
from tandem.operators import link as J
from tandem.operators import retrieve as R
from tandem.operators._shared import scratch
from tandem.plans import queries_relations as Q
from tandem.plans import tables as X
from tandem.plans.registry import query
from tandem.sources import files as S


def _lines(df: DataFrame, line, name: str) -> str:
    """Write one line for each row (a value may hold several) and return the folder."""
    path = scratch(df.sparkSession, name)
    df.select(line.alias("value")).write.option("maxRecordsPerFile", 50_000).text(path)
    return path


def _tabs(*columns):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def _ordered_files(df: DataFrame, file, order: list, line, name: str) -> str:
    """Files `file=<number>` with the lines in order, each file by one task; the number of files grows with the table."""
    path = scratch(df.sparkSession, name)
    parts = df.select(file.alias("file"), line.alias("value"), *[o.alias(f"_{i}") for i, o in enumerate(order)]).repartition("file")
    parts.sortWithinPartitions("file", *[f"_{i}" for i in range(len(order))]).select("file", "value").write.partitionBy("file").text(path)
    return path


def _file_of(column: str):
    return F.regexp_extract(column, "file=([0-9]+)", 1).cast("long")


def _file():
    return F.floor(F.col("doc_id") / 1000)


@query(f"WITH {X.TOKENS} SELECT doc_id // 1000 AS file, dense_rank() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, sent_no) - 1 AS sent_no, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) - 1 AS tok_no, form, token AS lemma, tag FROM tokens")
def read_vtext(s, d):
    """The documents as vertical text, a thousand of them a file, and back: every token in its place."""
    n = lambda f: F.length(f)
    tag = lambda f: F.when(n(f) >= 6, "N").when(n(f) <= 2, "A").otherwise("V")
    words = F.filter(F.split(F.translate("line", ".,", ""), " "), lambda f: f != "")
    sentence = F.concat(F.array_join(F.transform(words, lambda f: F.concat_ws("\t", f, F.lower(f), tag(f))), "\n"), F.lit("\n"))
    path = _ordered_files(X.sentences(s, d).where(F.size(words) > 0), _file(), [F.col("doc_id"), F.col("sent_no")], sentence, "vtext")
    return S.read_vtext(s, path).select(_file_of("doc_name").alias("file"), "sent_no", "tok_no", "form", "lemma", "tag")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord, 'root/' || doc_id AS doc_name FROM documents")
def read_doc_list(s, d):
    """One list in several files, whose names are in order."""
    docs = X.table(s, d, "documents")
    path = scratch(s, "doc-list")
    docs.select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string")).write.text(path)
    return S.read_doc_list(s, path, "root/")


def _vector_lines(s, d):
    v = X.vectors(s, d)
    path = scratch(s, "vectors")
    v.repartitionByRange("item_id").sortWithinPartitions("item_id").select(_tabs("item_id", F.array_join(F.transform("vec", lambda x: x.cast("string")), ";"))).write.text(path)
    return path


@query(f"WITH {X.VECTORS} SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_id, CAST(item_id AS VARCHAR) AS doc_name, round(list_sum(list_filter(vec, lambda x: abs(x) > 0.01)), 4) AS total, len(list_filter(vec, lambda x: abs(x) > 0.01)) AS n FROM v WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') AND item_id IN (SELECT doc_id FROM documents)")
def read_vector_csv(s, d):
    docs = X.table(s, d, "documents")
    names = lambda df: df.select(F.col("doc_id").cast("string").alias("doc_name"))
    v = S.read_vector_csv(s, _vector_lines(s, d), 64, eps=0.01, include=names(docs), exclude=names(docs.where("lang = 'de'")))
    n = F.size(F.filter("vec", lambda x: x != 0)).cast("long")
    return v.select("item_id", "doc_name", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), n.alias("n"))


def _links_read(s, d):
    return S.read_links(s, _lines(X.links(s, d), _tabs("text_name", "image_name"), "links"))


_LINK_TEXT = f"WITH {X.LINKS}, t AS (SELECT CAST(text_name AS VARCHAR) AS text_name, CAST(image_name AS VARCHAR) AS image_name FROM links) "


@query(_LINK_TEXT + "SELECT text_name, array_to_string(list_sort(list(DISTINCT image_name)), ';') AS images FROM t GROUP BY text_name")
def read_links_forward(s, d):
    return S.forward_links(_links_read(s, d)).select("text_name", F.array_join("images", ";").alias("images"))


@query(_LINK_TEXT + "SELECT image_name, array_to_string(list_sort(list(DISTINCT text_name)), ';') AS texts FROM t GROUP BY image_name")
def read_links_backward(s, d):
    return S.backward_links(_links_read(s, d)).select("image_name", F.array_join("texts", ";").alias("texts"))


@query(f"WITH {X.VECTORS} SELECT 'w' || item_id AS word, round(list_sum(vec), 4) AS total FROM v")
def read_word_vectors(s, d):
    v = X.vectors(s, d)
    line = F.concat_ws(" ", F.concat(F.lit("W"), "item_id"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
    head = v.agg(F.concat_ws(" ", F.count("*").cast("string"), F.lit("64")).alias("line"))
    rows = S.read_word_vectors(s, _lines(head.unionByName(v.select(line.alias("line"))), F.col("line"), "words"), lowercase=True)
    return rows.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_A = f"WITH {X.ANNOTATIONS} "


@query(_A + "SELECT id, CAST(\"user\" AS VARCHAR) AS \"user\", time, array_to_string(appropriate, ';') AS appropriate, len(inappropriate) AS n_inappropriate FROM a")
def read_annotation_outputs(s, d):
    a = X.annotations(s, d).withColumn("skipped", F.lit("no"))
    path = scratch(s, "annotations")
    S.write_annotations(a, path, ["id", "user", "time", "skipped", "appropriate", "inappropriate"])
    rows = S.read_annotation_outputs(s, path)
    return rows.select("id", "user", "time", F.array_join("appropriate", ";").alias("appropriate"), F.size("inappropriate").cast("long").alias("n_inappropriate"))


@query(_A + "SELECT id, label, CAST(id % 5 AS INTEGER) AS priority, CAST(text AS VARCHAR) AS text, len(images) AS n FROM a")
def read_annotation_inputs(s, d):
    a = X.annotations(s, d)
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("id", "label")], (F.col("id") % 5).cast("string"), F.lit("any"), F.col("text").cast("string"), F.array_join("images", ";"))
    rows = S.read_annotation_inputs(s, _lines(a, line, "inputs"))
    return rows.select("id", "label", "priority", "text", F.size("images").cast("long").alias("n"))


_HITS = Q._TOPK + "SELECT CAST(query_id AS VARCHAR) AS text, CAST(target_id AS VARCHAR) AS image, {} AS sim FROM r WHERE rank <= 10"


@query(_HITS.format("sim"))
def read_results(s, d):
    path = scratch(s, "results")
    S.write_results(Q._hits(s, d), path)
    return S.read_results(s, path)


@query(_HITS.format("sim"))
def read_results_t2i(s, d):
    path = scratch(s, "results")
    S.write_results(Q._hits(s, d), path)
    return S.read_results(s, path, "t2i")


@query(_HITS.format("CAST(NULL AS DOUBLE)"))
def read_results_map(s, d):
    path = scratch(s, "map")
    S.write_links(Q._hits(s, d), path)
    return S.read_results(s, path, "vtext-image-map")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) SELECT doc_id // 1000 AS file, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, k) - 1 AS line_no, array_to_string(list_filter(string_split_regex(line, '[ \\t\\r\\f\\v]+'), lambda w: w <> ''), ' ') AS words FROM l")
def read_wordlines(s, d):
    """A thousand documents a file, one line of a document a line."""
    path = _ordered_files(X.sentences(s, d), _file(), [F.col("doc_id"), F.col("sent_no")], F.col("line"), "wordlines")
    rows = S.read_wordlines(s, path)
    return rows.select(_file_of("doc_name").alias("file"), "line_no", F.array_join("words", " ").alias("words"))


@query(Q._TOPK + "SELECT CAST(query_id AS VARCHAR) AS text, string_agg(target_id, ';' ORDER BY rank) AS images, string_agg(printf('%.5f', sim), ';' ORDER BY rank) AS sims FROM r WHERE rank <= 10 GROUP BY query_id")
def format_results(s, d):
    return S.format_results(Q._hits(s, d))


@query(f"WITH {X.CELLS} SELECT feature AS token, count(*) AS df, sum(value) AS cf FROM cells GROUP BY feature")
def materialize(s, d):
    path = scratch(s, "vocab")
    S.materialize(B.build_vocab(X.cells(s, d)), path)
    return S.materialize(s.createDataFrame([], "token string, df long, cf double"), path)  # what is there is used


@query(f"WITH {X.MATRIX} SELECT item_id, feature, value FROM m")
def read_mm(s, d):
    m = X.matrix(s, d)
    line = F.concat_ws(" ", *[(F.col(c) + 1).cast("string") for c in ("item_id", "feature")], F.col("value").cast("string"))
    head = m.agg(F.concat_ws(" ", F.lit("%"), F.count("*").cast("string")).alias("line"))  # a comment
    size = m.agg(F.concat_ws(" ", *[(F.max(c) + 1).cast("string") for c in ("item_id", "feature")], F.count("*").cast("string")).alias("line"))
    first = head.unionByName(size).coalesce(1).select("line")  # two lines
    return S.read_mm(s, _lines(first.unionByName(m.select(line.alias("line"))), F.col("line"), "mm"))


@query(f"WITH {X.LINKS}, {X.VECTORS} SELECT DISTINCT text_name, item_id, label FROM links JOIN v ON item_id = image_name - image_name % 2")
def apply_dedup(s, d):
    v = X.vectors(s, d)
    classes = v.select("item_id", (F.col("item_id") - F.col("item_id") % 2).alias("representative"))
    kept, links = R.apply_dedup(v, X.links(s, d).withColumnRenamed("image_name", "item_id"), classes)
    return links.join(kept.select("item_id", "label"), "item_id").select("text_name", "item_id", "label")


@query("SELECT least(count(*), 7) AS n FROM documents")
def head(s, d):
    return D.head(X.table(s, d, "documents"), 7).agg(F.count("*").alias("n"))


@query(f"WITH {X.VECTORS} SELECT item_id, label FROM v")
def component(s, d):
    v = X.vectors(s, d)
    zipped = J.zip_aligned({"a": v.select("item_id", "label"), "b": v.select("item_id", "vec")})
    return J.component(zipped, "a").select("item_id", "label")


@query(_A + "SELECT id, len(images) - 1 AS others, len(appropriate) + len(inappropriate) AS marked FROM a")
def annotation_added_columns(s, d):
    a = A.add_column(X.annotations(s, d), "others", F.size("images") - 1)
    a = A.apply_on_columns(a, ["appropriate", "inappropriate"], lambda x, y: F.size(x) + F.size(y), "marked")
    return a.select("id", F.col("others").cast("long").alias("others"), F.col("marked").cast("long").alias("marked"))


@query(_A + "SELECT text, count(*) AS n, max(id) AS last FROM a GROUP BY text")
def annotation_groups(s, d):
    g = A.group_by(X.annotations(s, d), "text")
    return g.select("text", F.size("rows").cast("long").alias("n"), F.array_max(F.transform("rows", lambda r: r["id"])).alias("last"))


@query(_A + "SELECT CAST(sum(len(appropriate)) AS BIGINT) AS n FROM a")
def annotation_count_by_len(s, d):
    return A.count_by_len(X.annotations(s, d), "appropriate").select(F.col("n").cast("long").alias("n"))
