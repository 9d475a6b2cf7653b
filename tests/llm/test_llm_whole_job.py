"""Cases in which a training-data operator has to do the whole job, against plain brute force."""

import numpy as np
import pytest

from tandem.llm import bitslice, decontaminate, packing, url_filter


def best_fit(counts, capacity):
    """Brute force: rooms after plain best-fit decreasing, piece by piece."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits)[1]] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


HOT = [{1500: 100, 100: 300}, {2000: 50, 1: 2000}, {1500: 3, 700: 2, 300: 7, 100: 11, 1: 90}, {2048: 3, 1: 5}, {1: 5000}]


@pytest.mark.parametrize("counts", HOT + [{int(x): int(n) for x, n in np.random.default_rng(i).integers(1, 60, (12, 2)) * [30, 1]} for i in range(5)])
def test_packing_fills_rooms_with_repeated_lengths(counts):
    taken, ranks = {}, {}
    for length, first, end, seq, offset in packing.plan(counts, 2048):
        ranks.setdefault(length, []).extend(range(first, end))
        for i in range(end - first):
            taken.setdefault(seq + i, []).append((offset, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for own in taken.values():
        ends = [0, *(o + n for o, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1]
    assert sorted(2048 - sum(n for _, n in own) for own in taken.values()) == best_fit(counts, 2048)


def test_near_copies_are_judged_by_row(spark):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(4))
    rows = [(2, a), (5, a + " end"), (5, b), (9, b), (7, c), (7, c), (None, c), (None, d), (None, d), (1, ""), (1, ""), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(2, a), (5, b), (7, c), (None, d), (1, ""), (1, ""), (None, None), (3, None)], key=str)


def test_search_with_repeated_queries_and_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(120, 8)).round(2)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [rows[0]] * 6 + [rows[7]] * 3 + [(50, [float(x) for x in v[3]])]  # repeated rows; an id with two query vectors
    best = np.argsort(-(v @ v[0]))
    rows += [(int(best[0]), [float(x) * f for x in v[0]]) for f in (3, 4, 5, 6, 7, 8, 9)]  # an id with many of the best vectors
    rows += [(0, [float(x) * f for x in v[0]]) for f in (2, 2.5)]  # own vectors among the best
    q = bitslice.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in bitslice.search(q.where("id % 50 = 0"), q, 5, block_rows=64).collect()}
    at = {}
    for i, x in rows:
        at.setdefault(i, []).append(np.floor(np.array(x) * 256).astype(int))
    for a in (0, 50, 100):
        want = sorted((-max(int(x @ y) for x in at[a] for y in at[b]), b) for b in at if b != a)[:5]
        assert [got.get((a, r)) for r in range(1, 6)] == [(b, -s) for s, b in want]


def test_containment_of_short_and_unspaced_items(spark):
    items = spark.createDataFrame([(1, "Who wrote it, then?"), (2, "今日は天気がとても良いです"), (3, "one two three four five six"), (4, "zebra"), (5, "...")], "item_id long, text string")
    texts = [(1, "He asked: who wrote it then? Nobody knew."), (2, "who wrote then it"), (3, "彼は今日は天気がとても良いですと言った"), (4, "one two three four five six seven"), (5, "A Zebra."), (6, "今日は雨です"), (7, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.contained(docs, items, short=True).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in got} == {(1, 1, 1), (3, 2, 9), (4, 3, 2), (5, 4, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 6, 7]


def test_distrust_reaches_hosts_far_from_a_seed(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    hosts = [*[f"h{i}.io" for i in range(30)], "blocked.net"]
    pages = [(i, f"http://{h}/", link(*hosts[i + 1 : i + 2])) for i, h in enumerate(hosts)]
    pages += [(100, "http://c1.io/", link("c2.io", "blocked.net")), (101, "http://c2.io/", link("c1.io"))]  # a circle
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["verdict"] for r in rows} == {"block"}
    at = {h: i for i, h in enumerate([*hosts, "c1.io", "c2.io"])}
    back = np.zeros((len(at), len(at)))  # mass moves against the links, in equal shares
    for a, b in [*zip(hosts, hosts[1:]), ("c1.io", "c2.io"), ("c1.io", "blocked.net"), ("c2.io", "c1.io")]:
        back[at[a], at[b]] = 1
    back /= np.maximum(back.sum(axis=0), 1)
    want = np.linalg.solve(np.eye(len(at)) - 0.85 * back, 0.15 * (np.arange(len(at)) == at["blocked.net"]))
    got = {r["host"]: r["distrust"] for r in rows}
    assert all(abs(got[h] - want[i]) <= 1e-5 * want[i] for h, i in at.items())
