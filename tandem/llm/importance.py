"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (documents labelled good) and one of all raw text, give
each document a log ratio: the sum over its uni- and bigrams of log p_target - log p_raw.  Documents are resampled
without replacement in proportion to that ratio: a Gumbel variate, a hash of the document, is added, and the k largest
sums stay.  k is the number of documents whose ratio reaches the threshold that best separates good from bad among
labelled documents that the target model has not seen.

Raw counts cover all documents.  The labelled sample is at most `sample` rows, those with the smallest hashes; half of
it fits the target model and half sets the threshold.  The driver holds the two models (`buckets` counts each), the
scores of the labelled sample and histograms of fixed size.

Words are runs of letters, digits and non-ASCII characters, or runs of punctuation; A-Z are lower-cased.  Null or empty
text scores 0.  Documents that tie with the last one selected are selected too, and repeated rows get equal keys.
Without labels of both kinds the threshold is 0.  An empty table gives no rows.  Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tandem.llm._common import WORD_PUNCT, batches, small_batches, text_bytes, window_hashes, word_hashes, written

#: Bytes of text whose n-grams are held at once.
HELD = 1_000_000


def _features(col: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each uni- and bigram."""
    buf, offs = text_bytes(col)
    _, _, row, h = word_hashes(buf, offs, WORD_PUNCT, lower=True)
    pair = window_hashes(h, 2)
    same = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    n = np.uint64(buckets)
    return np.concatenate([row, row[:-1][same]]), np.concatenate([h % n, pair[same] % n]).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """`docs` with `_role`: 1 and 0 for good and bad documents that fit, 3 and 2 for those that set the threshold, else null.

    At most `sample` labels, so the side that is broadcast is bounded.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.min("quality").alias("q"))
    few = one.orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample)
    role = F.when(F.col("q") >= 1, 1).otherwise(0) + F.when(F.pmod(F.xxhash64("_label_id", F.lit(1)), F.lit(2)) == 0, 2).otherwise(0)
    few = few.select("_label_id", role.cast("int").alias("_role"))
    return docs.join(F.broadcast(few), F.col("doc_id").cast("long") == F.col("_label_id"), "left").drop("_label_id")


def fit(docs: DataFrame, buckets: int = 10_000, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of each bucket, from all of `docs` (text, _role)."""

    def count(frames):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches(frames, HELD):
            row, bucket = _features(b.column("text"), buckets)
            good = b.column("_role").fill_null(-1).to_numpy() == 1
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[good[row]], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(buckets), "raw": raw, "target": target})

    rows = docs.select("text", "_role").mapInArrow(count, "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    with small_batches(docs.sparkSession):
        sums = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    share = lambda x: np.log(x + smooth) - np.log(x.sum() + smooth * buckets)
    return share(target) - share(raw)


def scored(docs: DataFrame, ratio: np.ndarray, texts: bool = False) -> DataFrame:
    """The columns of `docs`, `text` only if asked for, n_grams and log_ratio of each document."""
    buckets = len(ratio)
    keep = [c for c in docs.columns if texts or c != "text"]

    def score(frames):
        for b in batches(frames, HELD):
            row, bucket = _features(b.column("text"), buckets)
            total = np.bincount(row, ratio[bucket], b.num_rows)
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(total, pa.float64())], [*keep, "n_grams", "log_ratio"])

    new = [StructField("n_grams", LongType()), StructField("log_ratio", DoubleType())]
    return docs.mapInArrow(score, StructType([*(docs.schema[c] for c in keep), *new]))


def threshold(scores: np.ndarray, good: np.ndarray, care: float = 4.0) -> float:
    """The value that best separates good from bad documents, a lost share of the good ones counting `care` times.

    0 if one kind is missing.
    """
    if not good.any() or good.all():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    gain = care * np.cumsum(g) / g.sum() - np.cumsum(~g) / (~g).sum()
    gain[:-1][s[:-1] == s[1:]] = -np.inf
    i = len(gain) - 1 - int(gain[::-1].argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column, by histograms of ever smaller ranges."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    while True:
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if not width or low + width == low or high - width == high:
            return low
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        rows = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if low == high or r["n"] == 1:
            return low


def select(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, buckets: int = 10_000, sample: int = 20_000, seed: int = 1) -> DataFrame:
    """`keep` (default: doc_id), n_grams, log_ratio, key (ratio and Gumbel variate) and selected of each document.

    The new columns replace those of `keep` that have the same name.
    """
    keep = [c for c in keep or ["doc_id"] if c not in NEW]
    u = F.xxhash64("doc_id", "text", F.lit(seed)).alias("_u")
    others = F.struct(F.lit(0).alias("_"), *[c for c in keep if c != "text"]).alias("_row")  # whatever their names
    marked = labelled(docs.select("doc_id", "text", u, others), labels, sample)
    ratio = fit(marked, buckets)
    wide = "text" in keep  # texts aren't stored a second time: they are scored again
    table = written(scored(marked.select("text", "_role", "_u", *([] if wide else ["_row"])), ratio), "scores")
    rows = table.where("_role >= 2").select("log_ratio", "_role").collect()  # at most `sample` labels
    least = threshold(np.array([r[0] for r in rows]), np.array([r[1] == 3 for r in rows], bool))
    uniform = (F.pmod("_u", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.col("log_ratio") - F.log(-F.log(uniform))
    keyed = table.withColumn("key", key)
    k = table.where(F.col("log_ratio") >= least).count()
    last = kth_largest(keyed, "key", k)
    chosen = F.col("key") >= last if last is not None else F.lit(False)
    if wide:
        keyed = scored(marked.select("text", "_u", "_row"), ratio, texts=True).withColumn("key", key)
    return keyed.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in keep], "n_grams", "log_ratio", "key", chosen.alias("selected"))


#: Columns that `select` adds.
NEW = ("n_grams", "log_ratio", "key", "selected")
