"""One length, one id and one host over most of the rows."""

from tandem.llm import packing, url_filter


def test_one_length_and_no_ids(spark):
    rows = [(None, 0, 0, 100, 7)] * 3000 + [(i, 0, 0, 48, i) for i in range(150)]
    pieces = spark.createDataFrame(rows, packing.PIECES).repartition(6)
    out = packing.pack(pieces, capacity=2048, spread=2, group_rows=50)
    got = {}
    for r in out.collect():
        got.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 150 and sum(map(len, got.values())) == 3150
    for places in got.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == 2048  # twenty of one length and one of the other


def test_one_host_over_most_pages(spark):
    hot = [(i, "http://hot.org/x", '<a href="http://seed.net/">') for i in range(2000)]
    rest = [(2000, "http://seed.net/", None), (2001, "http://cold.org/", '<a href="http://hot.org/">'), (2002, None, None)]
    df = spark.createDataFrame(hot + rest, "page_id long, url string, html string").repartition(7)
    for limit in (1_000_000, 0):  # broadcast, and a join by host
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, broadcast_rows=limit).collect()}
        assert len(got) == 2003
        assert {got[i] for i in range(2000)} == {"block"} and got[2000] == "block"  # it links to a blocked host
        assert got[2001] == "block" and got[2002] == "allow"


def test_small_graphs_take_few_tasks_whatever_the_shuffle_partitions(spark):
    from tandem.llm._graph import components

    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.range(300).selectExpr("id * 2 + 1 AS a", "id * 2 AS b")
        found = components(edges, 300)
        assert {(r["node"], r["root"]) for r in found.collect()} == {(2 * i + 1, 2 * i) for i in range(300)}
        assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
