"""Files read in many blocks, against plain loops over the whole file."""

import gzip
import random

import pytest

from tandem.sources import files, lines


@pytest.fixture
def small_blocks(spark):
    """Blocks of about 300 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(text):
    """(sent_no, tok_no, line) of each token, and (line_no, line) of each line."""
    tokens, sent, tok = [], 0, 0
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line.strip(" ") == "":
            sent, tok = sent + 1, 0
        else:
            tokens.append((sent, tok, line))
            tok += 1
    return tokens


def make(rng, n):
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2:
            out.append("")
        elif kind < 0.25:
            out.append("  ")
        elif kind < 0.3:
            out.append("x" * rng.randrange(200, 900))  # longer than a block
        else:
            out.append("\t".join(rng.choice(["Haus", "haus", "é", "N"]) + str(rng.randrange(99)) for _ in range(3)))
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n", "\n\n"])


@pytest.mark.parametrize("seed", range(3))
def test_vertical_text_in_blocks(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    texts = {f"{i}.vert": make(rng, rng.choice([1, 40, 300])) for i in range(4)}
    texts["one.vert"] = "a\tb\tc\n" * 300  # one sentence over all blocks
    texts["blank.vert"] = "\n" * 900
    texts["empty.vert"] = ""
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with gzip.open(tmp_path / "z.vert.gz", "wb") as f:  # can't be split
        f.write(texts["0.vert"].encode())
    texts["z.vert.gz"] = texts["0.vert"]
    blocks = lines._blocks(spark, str(tmp_path)).select("file", "block").distinct().count()
    assert blocks > 8 * 2
    got = {}
    for r in files.read_vtext(spark, str(tmp_path), columns=("a", "b", "c")).collect():
        got.setdefault(r["doc_name"].split("/")[-1], []).append((r["sent_no"], r["tok_no"], "\t".join(x for x in (r["a"], r["b"], r["c"]) if x is not None)))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain(t) for k, t in texts.items() if plain(t)}


def test_lines_over_several_files(spark, tmp_path, small_blocks):
    rng = random.Random(9)
    names = [f"part-{i:05d}" for i in range(3)]
    texts = [[f"{rng.randrange(10**9)} w" if rng.random() < 0.9 else "" for _ in range(200)] for _ in names]
    for name, rows in zip(names, texts, strict=True):
        (tmp_path / name).write_text("".join(x + "\n" for x in rows))
    want = [(i, x) for i, x in enumerate(sum(texts, [])) if x]
    assert sorted(tuple(r) for r in files.read_doc_list(spark, str(tmp_path)).collect()) == want
    got = files.read_wordlines(spark, str(tmp_path)).collect()
    assert sorted((r["doc_name"].split("/")[-1], r["line_no"], " ".join(r["words"])) for r in got) == sorted((n, i, x) for n, rows in zip(names, texts, strict=True) for i, x in enumerate(rows))


def test_vector_ids_follow_the_file(spark, tmp_path, small_blocks):
    rows = [(f"n{i}", [i / 10, -0.001, 0.5]) for i in range(120)]
    (tmp_path / "v.csv").write_text("".join(f"{n}\t{';'.join(map(str, v))}\n" for n, v in rows))
    name = lambda *x: spark.createDataFrame([(f"n{i}",) for i in x], "doc_name string")
    got = files.read_vector_csv(spark, str(tmp_path / "v.csv"), 3, eps=0.01, include=name(*range(5, 100)), exclude=name(7, 8, 200)).collect()
    want = [i for i in range(5, 100) if i not in (7, 8)]
    assert sorted((r["item_id"], r["doc_name"], tuple(r["vec"])) for r in got) == [(k, f"n{i}", (i / 10, 0.0, 0.5)) for k, i in enumerate(want)]
    with pytest.raises(Exception, match="another dimension"):
        files.read_vector_csv(spark, str(tmp_path / "v.csv"), 4).collect()
