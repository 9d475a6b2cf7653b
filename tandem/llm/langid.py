"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (one to three letters, a blank standing for the border of
a word) in order of frequency.  A document's own list is compared to each profile: an n-gram costs the distance
between its two ranks, or the length of the profile where the profile lacks it.  The language with the smallest sum
wins; ties go to the smaller name.

Counts cover all training documents and are summed in Spark.  The driver holds the profiles only: `size` n-grams
for each language.  Whole texts are read.

Null text, or text without a letter: `und`, score 0.  Rows whose language is null are not learned from; with no
profile at all every document is `und`.  Repeated rows are judged each on its own.  An empty table gives no rows.
Only text, lang and the columns of `keep` are read, so other columns may have any name.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm._common import batches

UNKNOWN = "und"
_CHAR = 21  # bits of a code point


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to that of its lower-case letter; 32 for what isn't a letter."""
    out = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one blank at least around each text, and where each text begins."""
    joined = " ".join(["", *texts, ""])
    x = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return x, starts


def _grams(x: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 letters with blanks at their ends only."""
    x = x.astype(np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    one = x[x != 32]
    two = (x[:-1] << _CHAR | x[1:])[(x[:-1] != 32) | (x[1:] != 32)]
    three = (a << 2 * _CHAR | b << _CHAR | c)[(b != 32)]
    return np.concatenate([one, two, three])


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, int)
    return codes[edge], np.diff(np.append(edge, len(codes)))


def learn(docs: DataFrame, size: int = 400, spread: int = 32) -> DataFrame:
    """Profiles from documents (text, lang): rows (lang, gram, rank), rank from 0, at most `size` for a language."""

    def count(frames):
        for b in batches(frames, 2_000_000):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                x, _ = _letters_of([texts[i] for i in np.flatnonzero(langs == lang)])
                grams, n = _counted(_grams(x))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams)), "gram": grams, "n": n})

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    totals = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = (F.col("n").desc(), "gram")
    some = Window.partitionBy("lang", F.pmod("gram", F.lit(spread))).orderBy(*order)
    best = totals.withColumn("r", F.row_number().over(some)).where(F.col("r") <= size)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < size).select("lang", "gram", "rank")


def predict(docs: DataFrame, profiles: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = 400) -> DataFrame:
    """`keep`, lang_pred and score (1: the lists agree, 0: nothing in common) of each document."""
    rows = profiles.collect()  # size x languages
    langs = sorted({r["lang"] for r in rows})
    grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(grams) + 1, len(langs)), size, np.int32)
    for r in rows:
        ranks[np.searchsorted(grams, r["gram"]), langs.index(r["lang"])] = r["rank"]
    known = ranks < size

    def judge(frames):
        for b in batches(frames, 2_000_000):
            texts = b.column("text").fill_null("").to_pylist()
            x, starts = _letters_of(texts)
            preds, scores = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                own = x[s : e + 1]  # with a blank at either end
                if not langs or not (own != 32).any():
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                codes, n = _counted(_grams(own))
                top = codes[np.argsort(-n.astype(np.int32), kind="stable")[:size]]
                at = np.searchsorted(grams, top)
                at[at == len(grams)] = len(grams)
                miss = np.ones(len(top), bool)
                inside = at < len(grams)
                miss[inside] = grams[at[inside]] != top[inside]
                at[miss] = len(grams)
                gap = np.abs(ranks[at] - np.arange(len(top), dtype=np.int32)[:, None])
                gap[~known[at]] = size
                total = gap.sum(axis=0)
                best = int(total.argmin())
                preds.append(langs[best])
                scores.append(float(1 - total[best] / (size * len(top))))
            kept = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    taken = docs.select(*keep, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return taken.mapInArrow(judge, ", ".join([*kinds, "lang_pred string", "score double"]))
