"""Text-file sources and sinks, each a thin arrangement of Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators._shared import MAX_LISTED, bounded
from tandem.operators.bow import with_ids
from tandem.sources.lines import numbered_lines


def _file_order():
    """Where a line stands: its file, the part of the file that a task reads, and the order in that task."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at"))


def read_vtext(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = ("form", "lemma", "tag"), delimiter: str = "\t") -> DataFrame:
    """Vertical text, one token a line, a blank line after each sentence: doc_name, sent_no, tok_no and the columns.

    A file is a document, read in as many blocks as Spark cuts it into; it may be gzipped.  Two blank lines in a row
    make an empty sentence that still counts.
    """
    lines = numbered_lines(spark, paths).where(~F.col("blank"))
    parts = F.split("value", F.lit(delimiter))
    return lines.select(F.col("file").alias("doc_name"), F.col("blanks").alias("sent_no"), F.col("since").alias("tok_no"), *[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def read_doc_list(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """doc_ord (the line's number, blank lines counted; several files follow each other by name) and doc_name of a document list."""
    name = F.trim("value")
    return numbered_lines(spark, path).where(~F.col("blank")).select(F.col("line_all").alias("doc_ord"), (F.concat_ws("/", F.lit(root.rstrip("/")), name) if root else name).alias("doc_name"))


def read_vector_csv(spark: SparkSession, path: str, dim: int = 4096, delimiter: str = ";", eps: float | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """item_id, doc_name and vec of lines `name<TAB>v;v;...`; another dimension is an error. Name lists have doc_name.

    Excluded names are skipped first, then those not included; item ids count what is left, in file order.  Components
    of absolute value `eps` or less become 0.
    """
    parts = F.split("value", "\t")
    number = lambda x: x.cast("double") if eps is None else F.when(F.abs(x.cast("double")) > eps, x.cast("double")).otherwise(0.0)
    vec = F.transform(F.split(F.get(parts, 1), F.lit(delimiter)), number)
    rows = numbered_lines(spark, path).where(~F.col("blank")).select("line_all", F.get(parts, 0).alias("doc_name"), vec.alias("vec"))
    rows = rows.join(exclude.select("doc_name"), "doc_name", "left_anti") if exclude is not None else rows
    rows = rows.join(include.select("doc_name"), "doc_name", "left_semi") if include is not None else rows
    rows = rows.where(F.assert_true(F.size("vec") == dim, F.lit("a vector has another dimension")).isNull())
    ids = with_ids(rows.select("line_all"), ["line_all"], "item_id")  # numbers only are written and cut into ranges
    return rows.join(ids, "line_all").select("item_id", "doc_name", "vec")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="text_name string, image_name string")


def forward_links(links: DataFrame) -> DataFrame:
    """The images of each text as an array; more than `MAX_LISTED` are an error (keep the rows then)."""
    bounded(links, ["text_name"], MAX_LISTED)
    return links.groupBy("text_name").agg(F.sort_array(F.collect_set("image_name")).alias("images"))


def backward_links(links: DataFrame) -> DataFrame:
    """The texts of each image as an array; more than `MAX_LISTED` are an error (keep the rows then)."""
    bounded(links, ["image_name"], MAX_LISTED)
    return links.groupBy("image_name").agg(F.sort_array(F.collect_set("text_name")).alias("texts"))


def read_word_vectors(spark: SparkSession, path: str, lowercase: bool = False) -> DataFrame:
    """word and vec of a word2vec text file; the header's row count is checked, a repeated word's last row wins."""
    lines = spark.read.text(path).select("value", _file_order().alias("_at"))
    parts = F.split(F.trim("value"), " ")
    header = lines.where(F.size(parts) == 2).agg(F.min_by("value", "_at").alias("value")).select(F.get(parts, 0).cast("long").alias("size"), F.get(parts, 1).cast("int").alias("dim")).first()
    rows = lines.where(F.size(parts) == header["dim"] + 1).select("_at", F.get(parts, 0).alias("word"), F.transform(F.slice(parts, 2, header["dim"]), lambda x: x.cast("double")).alias("vec"))
    if rows.count() != header["size"]:
        raise ValueError("the number of rows differs from the header's")
    rows = rows.withColumn("word", F.lower("word")) if lowercase else rows
    return rows.groupBy("word").agg(F.max_by("vec", "_at").alias("vec"))


def read_annotation_outputs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="id long, user string, time long, skipped string, appropriate string, inappropriate string")
    return rows.withColumns({c: _split(c) for c in ("appropriate", "inappropriate")})


def read_annotation_inputs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep=" ", schema="id long, label string, priority int, prefer_user string, text string, images string")
    return rows.withColumn("images", _split("images"))


def _split(column: str):
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(column, ";"))


def read_results(spark: SparkSession, path: str, kind: str = "result") -> DataFrame:
    """text, image and sim (null unless given) of the formats `result`, `t2i` and `vtext-image-map`.

    The first two hold one line for each text; a repeated text is an error.
    """
    rows = spark.read.csv(path, sep="\t", schema="text string, images string, sims string")
    if kind == "vtext-image-map":
        return rows.select("text", F.col("images").alias("image"), F.lit(None).cast("double").alias("sim"))
    if not rows.groupBy("text").count().where("count > 1").isEmpty():
        raise ValueError("a text is repeated")
    sep = ";" if kind == "t2i" else "[;,]"
    strip = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.trim(x) != "")
    pairs = rows.select("text", F.explode(F.arrays_zip(strip("images").alias("image"), strip("sims").alias("sim"))).alias("p"))
    return pairs.select("text", F.trim("p.image").alias("image"), F.col("p.sim").cast("double").alias("sim"))


def read_wordlines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: doc_name (the file), line_no (from 0 within it) and its words."""
    lines = numbered_lines(spark, path)
    return lines.select(F.col("file").alias("doc_name"), "line_no", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("words"))


def format_results(results: DataFrame) -> DataFrame:
    """text, images and sims (five decimals) of results (query_id, target_id, sim, rank), in rank order; over `MAX_LISTED` of one query are an error."""
    bounded(results, ["query_id"], MAX_LISTED)
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "target_id", "sim"))).alias("r"))
    images = F.array_join(F.transform("r", lambda x: x["target_id"].cast("string")), ";")
    sims = F.array_join(F.transform("r", lambda x: F.format_string("%.5f", x["sim"])), ";")
    return rows.select(F.col("query_id").cast("string").alias("text"), images.alias("images"), sims.alias("sims"))


def write_results(results: DataFrame, path: str) -> None:
    format_results(results).write.csv(path, sep="\t", quote="")


def write_links(results: DataFrame, path: str) -> None:
    results.select("query_id", "target_id").write.csv(path, sep="\t", quote="")


def write_annotations(df: DataFrame, path: str, columns: Sequence[str], delimiter: str = ";") -> None:
    """Fixed column order, arrays joined; a missing column is an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {missing[0]}")
    kinds = dict(df.dtypes)
    df.select(*[F.array_join(c, delimiter).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]).write.csv(path, sep="\t", quote="")


def materialize(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write once, read from then on; what is there is used unless `overwrite`."""
    spark = df.sparkSession
    try:
        if not overwrite:
            return spark.read.parquet(path)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_mm(spark: SparkSession, path: str) -> DataFrame:
    """cells of a MatrixMarket coordinate file, ids from 0; the size line, which may be blank, is left out."""
    lines = spark.read.text(path).select("value", _file_order().alias("_at")).where(~F.col("value").startswith("%"))
    first = lines.agg(F.min("_at").alias("_first"))  # one row
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.join(F.broadcast(first)).where((F.size(parts) == 3) & (F.col("_at") != F.col("_first")))
    return rows.select((F.get(parts, 0).cast("long") - 1).alias("item_id"), (F.get(parts, 1).cast("long") - 1).alias("feature"), F.get(parts, 2).cast("double").alias("value"))
