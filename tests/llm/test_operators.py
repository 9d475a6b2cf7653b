"""The training-data operators against brute force, on the smallest tables and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tandem.llm import bitslice, decontaminate, importance, langid, licenses, near_dedup, packing, substring_dedup, token_files, url_filter

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a b c d e f " * 300), (5, "x y"), (5, "x y"), (6, "Ünï 漢字   text"), (None, "null id here"), (7, "one")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, score double"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 0.5) for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def removed(rows, k):
    """Brute force: number of removed words and digest of the kept ones."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out[i] = (sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def linked(rows, k, percent):
    """Brute force: component of each document."""
    sets = {i: frozenset(tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))) if w else frozenset() for i, t in rows.items() for w in [WORDS.findall(lower(t))]}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root[a], root[b]))
                    root = {i: x if r == y else r for i, r in root.items()}
    return root


def test_substring_dedup(spark, documents, texts):
    got = {r["doc_id"]: (r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.remove_repeats(documents.select("doc_id", "text"), 20).collect()}
    assert got == removed(texts, 20)


def test_substring_dedup_awkward(awkward, empty):
    got = {(r["doc_id"], r["text"]): (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(awkward, 20).collect()}
    assert got[(4, "a b c d e f " * 300)] == (1800, 1800 - 6)
    assert got[(1, None)] == (0, 0)
    assert substring_dedup.remove_repeats(empty, 20).count() == 0


def test_near_duplicates(spark, texts):
    rng = random.Random(5)
    rows = dict(list(texts.items())[:80])
    for i in range(40):  # near copies around the threshold
        w = (texts[i] or "").split()
        for _ in range(max(1, len(w) * rng.randint(1, 14) // 100)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows[1000 + i] = " ".join(w)
    for i in range(60):  # a group of copies of a copy, of which not all are similar to each other
        w = (texts[7] or "").split()
        for j in range(i // 6):
            w[j * 7 % len(w)] = f"v{j}"
        rows[2000 + i] = " ".join([*w, *["tail"] * (i % 6)])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == linked(rows, 2, 80)
    w = {i: WORDS.findall(lower(t)) for i, t in rows.items()}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len({tuple(x[p : p + 2]) for p in range(max(1, len(x) - 1))}) if x else 0 for i, x in w.items()}
    assert {r["doc_id"] for r in got if r["doc_id"] == r["component_id"]} == {i for i, r in linked(rows, 2, 80).items() if i == r}


def test_near_duplicates_awkward(awkward, empty):
    got = near_dedup.near_duplicates(awkward).select("doc_id", "component_id").collect()
    assert sorted((r[0] or 0, r[1] or 0) for r in got) == sorted((i or 0, i or 0) for i, _ in AWKWARD)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_containment(spark, documents, texts):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contained(documents, item).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sets = lambda t: {tuple(w[p : p + 5]) for w in [words(t)] for p in range(len(w) - 4)}
    own = {i: sets(t) for i, t in texts.items()}
    want = set()
    for r in item.collect():
        s = sets(r["text"])
        want |= {(i, r["item_id"], len(s & d)) for i, d in own.items() if s and 10 * len(s & d) >= 8 * len(s)}
    assert got == want


def test_containment_short_items(spark):
    texts = [(1, "say what is this now"), (2, "what, is THIS"), (3, "what is the this"), (4, "漢字かな x"), (5, None), (6, "a " * 50 + "one two"), (6, "one two")]
    items = [(1, "What is this"), (2, "かな"), (3, "two"), (4, ""), (5, "one two three four five"), (6, "字 か")]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items, short=True).collect())
    assert got == [(1, 1), (2, 1), (4, 2), (4, 6), (6, 3), (6, 3)]
    assert got == sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items, short=True, broadcast_rows=0).collect())


def test_containment_awkward(spark, awkward, empty):
    items = spark.createDataFrame([(1, None), (2, "a b"), (3, "a b c d e f a b c d")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contained(awkward, items).collect()] == [(4, 3)]
    assert decontaminate.contained(empty, items).count() == 0
    assert decontaminate.contained(awkward, items.limit(0)).count() == 0
    assert decontaminate.clean(awkward, items).count() == len(AWKWARD) - 1


def test_packing(spark, documents, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(packing.cut(documents, path)).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = set()
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


@pytest.mark.parametrize(("name", "byte_level"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder(name, byte_level, texts):
    from tokenizers import Tokenizer

    from tandem.llm._tokens import Encoder

    path = public_tokenizers.path(name)
    rng = random.Random(2)
    odd = ["hello <|endoftext|> world", "x<|startoftext|>y", "a<|ENDOFTEXT|>", "don't we'll 'S it''s", "  a  b\n\nc\t", "a" * 5000, "é1²3 x-y_z", "漢字 Ünï", " ", "", "!'s x's", "\u00a0a\u200b"]
    odd += ["".join(rng.choices(" abZé.,'\n0<|>", k=rng.randint(1, 40))) for _ in range(2000)]
    rows = [*odd, *[t or "" for t in texts.values()]]
    tok, own = Tokenizer.from_file(path), Encoder(path, byte_level)
    assert own.encode(rows) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(rows, add_special_tokens=False)]
    tok.encode_special_tokens = True
    own = Encoder(path, byte_level, special_as_text=True)
    assert own.encode(odd) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(odd, add_special_tokens=False)]


def test_packing_awkward(awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(packing.cut(awkward, path, capacity=16), capacity=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(packing.cut(empty, path)).count() == 0


def test_token_files(spark, tmp_path, documents, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(documents, str(tmp_path), path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    start, want = 0, []
    for i, t in sorted(texts.items()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = token_files.read_tokens(spark, str(tmp_path), with_ids=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_token_files_awkward(spark, awkward, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sorted(token_files.token_file_table(awkward, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))
    assert token_files.token_file_table(empty, path).count() == 0


def test_search(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)).round(2)
    v[50:200] = v[50]  # one vector in a third of all rows
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0, None] * 8), (902, [float("nan")] * 16)]
    q = bitslice.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in bitslice.search(q.where("id % 50 = 0"), q, 5, block_rows=64).collect()}
    x = np.floor(v * 256).astype(int)
    for a in range(0, 400, 50):
        best = sorted((-int(x[a] @ x[b]), b) for b in range(400) if b != a)[:5]
        assert [got[(a, r)] for r in range(1, 6)] == [(b, -s) for s, b in best]
    assert bitslice.search(q.limit(0), q, 5).count() == 0


def test_languages(documents, awkward, empty, spark):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    profiles = langid.learn(documents.where(~held))
    out = langid.predict(documents.where(held), profiles, keep=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in langid.predict(awkward, profiles).collect()}
    assert {(1, True), (2, True), (3, True), (4, False), (7, False)} <= got
    assert langid.predict(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.learn(empty)).collect()} == {"und"}


def test_licenses(spark, awkward, empty):
    text = "x y\n" + licenses.TEMPLATES["mit-grant"][0] + "\nThe MIT License. mit-license"
    df = spark.createDataFrame([(1, text), (2, "Apache, LICENSE apache license"), (3, "the license of apache")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert (got[1]["n_base"], got[1]["base_labels"]) == (2, "mit")
    assert "mit-grant" in got[1]["labels"].split(",")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (2, 0, 2, "apache")
    assert (got[3]["n_base"], got[3]["labels"], got[3]["first_word"]) == (0, "", None)
    assert licenses.scan(awkward).count() == len(AWKWARD)
    assert licenses.scan(empty).count() == 0


def test_quality(spark, documents, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = importance.select(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in out.collect()}
    assert kept[1] > 0.97
    assert kept[0] < 0.3
    assert importance.select(awkward, labels).count() == len(AWKWARD)
    assert importance.select(awkward, labels.limit(0)).count() == len(AWKWARD)
    assert importance.select(empty, labels).count() == 0


def test_kth_largest(spark):
    x = [float(v) for v in [5, 1, 1, 7, 7, 7, -3, 1e300]]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert [importance.kth_largest(df, "v", k) for k in range(1, 9)] == sorted(x, reverse=True)


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    pages = [
        (1, "http://a.net/x", link("far.com")), (2, "http://B.example.net/en/1?q", link("good.com")), (3, "http://good.com/", link("better.com")),
        (4, "http://bad.com", link("a.net")), (5, "http://worse.com/a#b", link("bad.com")), (6, "http://far.com/", None), (7, "http://a.net", ""),
        (8, None, "x"), (9, "nothing", None), (10, "http://x.org/fr/1", ""), (11, "http://better.com?x=/de/", ""), (1, "http://a.net/x", None),
    ]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("b.example.net", "/en/1", "example.net/en/", "allow"), 3: ("good.com", "/", None, "allow"),
        4: ("bad.com", "", None, "block"), 5: ("worse.com", "/a", None, "block"), 6: ("far.com", "/", None, "allow"), 7: ("a.net", "", None, "block"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("x.org", "/fr/1", "org/fr/", "allow"), 11: ("better.com", "", None, "allow"),
    }
    assert len(rows) == len(pages)


CLASH = "doc_id long, text string, lang string, n_grams string, log_ratio string, selected string, _u string, _role string, key string, _row string, _others string, n_words string, n_removed string, kept_text string, _id string, _hash string, component string, _doc string, piece string"
LONG = " ".join(f"q{i % 977} r{i}" for i in range(200_000))


@pytest.mark.parametrize("name", ["quality", "near_copies", "repeated_passages", "benchmark_leaks", "packing"])
def test_pipeline_awkward(spark, empty, name):
    """Nulls, empty and very long texts, shared ids, equal rows, clashing columns, an empty table: each stage by itself."""
    import corpus_pipeline

    stage = getattr(corpus_pipeline, name)
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60 ", "v60 ")
    rows = [(1, base), (5, near), (5, "quite another text of its own"), (7, "b c"), (7, "b c"), (None, near + " x"), (None, None), (8, ""), (9, None), (10, " \n"), (11, LONG)]
    columns = [c.split()[0] for c in CLASH.split(", ")]
    df = spark.createDataFrame([(i, t, "en", *[f"{c}{n}" for c in columns[3:]]) for n, (i, t) in enumerate(rows)], CLASH)
    out = stage(spark, df, DATA)
    if name == "packing":
        assert stage(spark, empty, DATA).count() == 0
        assert out.where("piece = 0").count() == len(rows)
        return
    assert out.columns == df.columns
    assert stage(spark, empty, DATA).columns == empty.columns
    assert stage(spark, empty, DATA).count() == 0
    got = out.collect()
    assert all(r["n_words"][7:] == r["_doc"][4:] for r in got)  # other columns stay with their row
    left = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    if name == "near_copies":
        want = [r for r in rows if r not in ((5, near), (None, near + " x"))]
        want.remove((7, "b c"))
        assert left == sorted(want, key=str)
    if name == "repeated_passages":
        want = [(None, near + " x"), (1, "w60"), (5, "quite another text of its own"), *[r for r in rows if r[0] != 1 and r[0] != 5 and r[1] != near + " x"]]
        assert left == sorted(want, key=str)
    if name == "benchmark_leaks":
        assert left == sorted(rows, key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from tandem.llm._common import written

        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = written(stage(spark, docs, DATA), "stage")
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.columns == docs.columns
        assert set(after) <= set(before)
        if "near" in name:
            root = linked(before, 5, 80)
            assert set(after) == {i for i, r in root.items() if i == r}
        if "substring" in name:
            want = removed(before, corpus_pipeline.PASSAGE)
            assert all(len(WORDS.findall(after.get(i) or "")) == len(WORDS.findall(t or "")) - want[i][0] for i, t in before.items())
        docs = out
    assert corpus_pipeline.packing(spark, docs, DATA).select("doc_id").distinct().count() == docs.count()
