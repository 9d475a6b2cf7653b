"""Packed bags of words: numbers come back, and votes and cosines of words equal the plain joins, also with few codes and in many blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.operators import bow, link, packed, retrieve, sparse_blocks, sparse_index
from tandem.operators.word_counts import counted


@pytest.fixture
def lines(spark):
    """Documents with frequent and rare words, one id twice, one without a word; an id of no document in between."""
    rng = random.Random(8)
    text = lambda i: " ".join(rng.choice(["all", "many", f"w{int(rng.paretovariate(0.6))}", f"own{i}"]) for _ in range(rng.randrange(1, 40)))
    rows = [(i, text(i)) for i in range(150)] + [(20, "w1 w2 own20 twice"), (40, None), (200, None)]
    return spark.createDataFrame(rows, "item_id long, line string").repartition(5)


@pytest.fixture(params=[1 << 21, 12, 0])
def blocks(request, monkeypatch):
    """So many words have codes; groups of queries have some blocks."""
    monkeypatch.setattr(packed, "CODED", request.param)
    monkeypatch.setattr(sparse_blocks, "GROUP_CELLS", 40)
    monkeypatch.setattr(sparse_blocks, "GROUP_BYTES", 300)
    monkeypatch.setattr(sparse_blocks, "WAITING_BYTES", 200)


@pytest.fixture(autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # items go over several batches
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbers_come_back():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << rng.integers(1, 45, 1000))
    ends = np.sort(np.r_[0, 0, rng.integers(0, 1000, 50), 1000, 1000])
    col = packed.pack(x, ends)
    for own, want in ((col, np.diff(ends, prepend=0)), (col.slice(9, 20), np.diff(ends)[8:28])):
        n, got = packed.unpack(own)
        first = 0 if own is col else ends[8]
        assert n.tolist() == want.tolist() and got.tolist() == x[first : first + want.sum()].tolist()
    assert [len(a) for a in packed.unpack(pa.array([], pa.binary()))] == [0, 0]
    assert [a.tolist() for a in packed.unpack(packed.pack(np.zeros(0, np.int64), np.zeros(3, int)))] == [[0, 0, 0], []]
    codes = np.array([0, 1, 7, 3, 300, 300])
    ends = np.array([0, 3, 3, 6])
    row, got = packed.codes_of(packed.pack(packed.gaps(codes, ends), ends))
    assert row.tolist() == [1, 1, 1, 3, 3, 3] and got.tolist() == codes.tolist()


@pytest.mark.parametrize("mode", ["hard", "soft"])
def test_votes_equal_the_join(spark, lines, blocks, mode):
    cells = counted(lines).where("feature <> ''")
    asked = counted(lines.where("item_id % 20 = 0")).where("feature <> ''")
    names = lines.select("item_id", F.concat(F.lit("d"), "item_id").alias("doc_name"))
    links = names.select(F.col("doc_name").alias("text_name"), F.explode(F.array(F.lit(0), F.col("item_id") % 11, F.col("item_id") * 7 % 30)).alias("image_name")).distinct()
    t = cells.join(names, "item_id").join(links, F.col("doc_name") == F.col("text_name")).select("feature", "image_name").distinct()
    want = asked.join(t, "feature").groupBy("item_id", "image_name").agg(F.sum("value" if mode == "soft" else F.lit(1.0)).alias("score"))
    got = link.votes(asked, cells, names, links, mode)
    assert got.count() and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("name", ["vote_hard", "vote_soft"])
def test_vote_queries_send_bags(spark, name):
    from tandem.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "xxhash64(feature" in plan and "word" not in plan


def test_words_topk_equal_tfidf(spark, lines, blocks):
    """Frequent words, and words of one or two documents: with few codes their frequencies come with the bag."""
    cells = counted(lines.unionByName(lines.where("item_id = 3").withColumn("item_id", F.lit(300).cast("long")))).where("feature <> ''")
    n = 153
    w = bow.tfidf(cells, n)
    sims = w.where("item_id % 20 = 0").alias("a").join(w.alias("b"), F.col("a.feature") == F.col("b.feature"))
    sims = sims.groupBy(F.col("a.item_id").alias("query_id"), F.col("b.item_id").alias("target_id")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("sim"))
    want = {(r["query_id"], r["rank"]): (r["target_id"], r["sim"]) for r in retrieve.ranked(sims, 4, 4).collect()}
    got = {(r["query_id"], r["rank"]): (r["target_id"], r["sim"]) for r in retrieve.similarity_topk_words(cells, "item_id % 20 = 0", n, 4, 4).collect()}
    assert len(want) > 20 and got == want


def test_words_topk_sends_bags(spark, monkeypatch):
    """Cells are neither written nor shuffled: only frequencies and bags are written."""
    from tandem.plans import queries

    names, written = [], retrieve.written
    for module in (retrieve, sparse_index, bow):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or written(df, name))
    queries.QUERIES["sim_topk_words"](spark, "/root/testdata/sf0.001")
    assert names == ["frequencies", "bags"]
