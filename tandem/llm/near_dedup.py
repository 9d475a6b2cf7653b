"""MinHash near-dedup with tensored banding, confirmed on full shingle sets.

Two small collections of `m` half keys are computed for each distinct shingle set, each half key from `half_rows`
minhashes.  The table keys are all m * m pairs of a half key of the first collection and one of the second, so
m * m bands of 2 * half_rows rows cost 2 * m * half_rows minhashes only.  With the defaults a pair of similarity
0.8 meets in no table with a chance of about 2e-6.

Few of the pairs of half keys have to be formed: a table key can be shared only if both of its half keys are, so only
half keys that hold more than one component are combined.  The steps are:

1. Documents with equal sets are one node.
2. A few table keys (`diagonal` pairs i, i; other pairs in later turns).  A table's lead is its node of the highest
   degree, the number of nodes that it shares these keys with: most often the text that the others are copies of.  In a
   turn, each node is compared with one lead of another component, so a turn costs one comparison for each node,
   however large the tables are.  Turns go on while a fifth of those nodes finds a link and a tenth of all is left.
3. The same turns over all table keys of half keys that hold more than one component, with up to `each` comparisons.
4. What is left: the nodes of tables that still hold more than one component.  Of a similar pair, the set that isn't
   larger shares one of the rarest ninth of its shingles with the rarest fifth of the other's, so such nodes meet again
   by these only, and pairs whose remaining shingles can't reach the similarity fall out in the join.  After that every
   pair of a table is in one component, compared, or shown to be too different, and no table's pairs were spelled out.

Candidates are confirmed by the intersection of their sets of 64-bit shingle hashes; nodes are 64-bit hashes of sets
(two different sets of a corpus of n agree with a chance of n * n / 2**65).  Links are joined by star rounds in Spark.

A document's set holds its distinct runs of `shingle` words (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`), or the whole
sequence if it is shorter.  Null, empty or blank texts have no set and are linked with nothing.  Rows that share a
doc_id are separate rows with the component of their own text; equal rows get equal results.  A null doc_id is never
kept and never names a component unless all of its component's ids are null.  An empty table gives no rows.  Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm._common import BLANK_SEPARATED, batches, few, mix, release, row_starts, temporary, text_bytes, window_hashes, word_hashes, written
from tandem.llm._graph import components

#: Another turn of the same kind follows if so many of the nodes compared were linked and so many of all were not.
LINKED, LEFT = 0.2, 0.1


def _sets(col: pa.Array, k: int):
    """Row and hash of each distinct shingle, sorted by row and hash; where each row's begin; hash of each whole set."""
    buf, offs = text_bytes(col)
    _, _, row, h = word_hashes(buf, offs, BLANK_SEPARATED, lower=True)
    n = len(col)
    starts = row_starts(row, n)
    whole = window_hashes(h, k)
    own = np.flatnonzero(row[: len(whole)] == row[k - 1 :]) if len(whole) else np.zeros(0, int)
    rows, hs = row[own], whole[own]
    short = [(r, x) for r in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < k)) for x in [window_hashes(h[starts[r] : starts[r + 1]], starts[r + 1] - starts[r])[0]]]
    if short:
        rows, hs = np.concatenate([rows, [r for r, _ in short]]), np.concatenate([hs, np.array([x for _, x in short], np.uint64)])
    order = np.lexsort((hs, rows))
    rows, hs = rows[order], hs[order]
    if len(rows):
        keep = np.concatenate(([True], (rows[1:] != rows[:-1]) | (hs[1:] != hs[:-1])))
        rows, hs = rows[keep], hs[keep]
    return rows, hs, row_starts(rows, n)


def _node(hs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash for the set of each row that has one."""
    run = np.zeros(len(hs) + 1, np.uint64)
    np.cumsum(mix(hs ^ np.uint64(0x5851F42D4C957F2D)), out=run[1:])
    s, e = starts[:-1], starts[1:]
    return mix((run[e] - run[s]) ^ mix((e - s).astype(np.uint64) + np.uint64(77))).view(np.int64)


def signatures(docs: DataFrame, shingle: int = 2, m: int = 26, half_rows: int = 4) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null without a set), and the half keys a and b of each document."""
    rng = np.random.Generator(np.random.PCG64(20))
    mul = rng.integers(0, 2**64, 2 * m * half_rows, np.uint64) | np.uint64(1)
    flip = rng.integers(0, 2**64, 2 * m * half_rows, np.uint64)
    schema = "doc_id long, text_hash long, n_shingles long, node long, a array<bigint>, b array<bigint>"

    def sign(frames):
        for batch in batches(frames, 500_000):
            _, hs, starts = _sets(batch.column("text"), shingle)
            n = np.diff(starts)
            full = np.flatnonzero(n)
            keys = np.zeros((len(full), 2 * m), np.uint64)
            for j in range(2 * m * half_rows):
                if len(full):
                    least = np.minimum.reduceat((hs ^ flip[j]) * mul[j], starts[:-1][full])
                    i = j // half_rows
                    keys[:, i] = mix(keys[:, i] ^ least) + np.uint64(i)
            node = _node(hs, starts)
            lists = []
            for half in (keys[:, :m], keys[:, m:]):
                offs = np.zeros(len(n) + 1, np.int32)
                offs[1:] = np.cumsum(np.where(n > 0, m, 0))
                lists.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(np.ascontiguousarray(half).view(np.int64).ravel())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, mask=n == 0), *lists],
                ["doc_id", "text_hash", "n_shingles", "node", "a", "b"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, schema)


def _sets_of(asked: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, n: int, broadcast_ids: int = 1_000_000) -> DataFrame:
    """node and own (its sorted shingle hashes) of the at most n nodes asked for, from the text of one document of each.

    Their ids are broadcast only if they have been counted and are few enough.
    """
    ids = written(few(nodes.join(asked, "node"), n).select(F.col("doc_id").alias("_asked"), F.col("node").alias("_node")), "asked")
    small = ids.count() <= broadcast_ids

    def make(frames):
        for b in batches(frames):
            _, hs, starts = _sets(b.column("text"), shingle)
            node = _node(hs, starts)
            ok = np.flatnonzero(node == b.column("_node").to_numpy())
            yield pa.RecordBatch.from_pydict({"node": node[ok], "own": pa.array([hs[starts[i] : starts[i + 1]].tobytes() for i in ok], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(ids) if small else ids, F.expr("_id <=> _asked"))
    return written(few(texts.select("_node", "text").mapInArrow(make, "node long, own binary").dropDuplicates(["node"]), n, 5_000), "sets")


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, shingle and place (from 0) of the rarest shingles of each set, one of which every similar set shares."""

    def spell(frames):
        for b in (f.slice(at, 500) for f in frames for at in range(0, f.num_rows, 500)):
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("own")]
            n = np.array([len(x) for x in own])
            yield pa.RecordBatch.from_pydict({"node": np.repeat(b.column("node").to_numpy(), n), "n": np.repeat(n, n), "shingle": np.concatenate(own)})
        release()

    spelled = written(sets.mapInArrow(spell, "node long, n long, shingle long"), "shingles")
    often = spelled.groupBy("shingle").agg(F.count("*").alias("c"))
    order = Window.partitionBy("node").orderBy("c", "shingle")
    placed = spelled.join(often, "shingle").withColumn("place", F.row_number().over(order) - 1)
    return placed.where(f"place <= n - ceil(n * {percent} / 100)").select("node", "n", "shingle", "place")


def _meeting(rare: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a rare shingle and can be similar enough.

    Of a similar pair the set that isn't larger shares one of its rarest n - ceil(2p / (1 + p) n) + 1 shingles, so only
    those are looked up among the rare ones of the others; a shingle common enough to stand behind them meets nothing.
    """
    several = rare.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    rare = rare.join(several, "shingle")
    small = rare.where(f"place <= n - ceil(n * {2 * percent} / {100 + percent})")
    other = rare.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "place")])
    can = f"100 * n >= {percent} * n_b AND (100 + {percent}) * least(n - place, n_b - place_b) >= {percent} * (n + n_b)"  # both sets from here on
    met = small.join(other, "shingle").where(f"(n < n_b OR n = n_b AND node < node_b) AND comp <> comp_b AND {can}")
    return met.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()


def _leads(rows: DataFrame, percent: int, turn: int, n: int, each: int = 1) -> DataFrame:
    """At most `each` pairs (a, b) for each of n nodes that shares a table with a lead of another component.

    A table's lead is its node of the highest degree.  Whose leads a node takes differs from turn to turn, except that
    the one of the highest degree is always among them.
    """
    lead = F.max(F.struct("degree", "node", "comp", "n")).alias("lead")
    tables = few(rows.groupBy("key").agg(lead, F.min("comp").alias("lo"), F.max("comp").alias("hi")), 8 * n).where("lo <> hi").select("key", "lead")
    can = f"comp <> lead.comp AND 100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)"
    met = few(rows.join(tables, "key"), 8 * n).where(can).select("node", F.col("lead.node").alias("lead"), F.pmod(F.xxhash64(F.lit(turn), "lead.node"), F.lit(each)).alias("draw"), "lead.degree")
    chosen = few(met.groupBy("node", "draw").agg(F.max(F.struct("degree", "lead")).alias("x")), each * n)
    return few(chosen.select(F.greatest("node", "x.lead").alias("a"), F.least("node", "x.lead").alias("b")).distinct(), each * n)


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, n: int) -> DataFrame:
    """Those of the n `pairs` (a, b) whose sets are similar enough."""
    sizes = nodes.select("node", "n_shingles")
    by = lambda c: sizes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"))
    pairs = few(few(pairs.join(by("a"), "a"), n).join(by("b"), "b"), n).where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = written(pairs.select("a", "b"), "pairs")
    asked = few(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n)
    sets = _sets_of(asked, docs, nodes, shingle, 2 * n)

    def compare(frames):
        for b in (f.slice(at, 1000) for f in frames for at in range(0, f.num_rows, 1000)):
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])
        release()

    named = lambda c, v: sets.select(F.col("node").alias(c), F.col("own").alias(v))
    met = few(few(pairs.join(named("a", "x"), "a"), n, 5_000).join(named("b", "y"), "b"), n, 5_000)
    return met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, m: int = 26, half_rows: int = 4, diagonal: int = 8, each: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, node and component_id (the smallest doc_id that links lead to) of each document.

    Components of rows that share a doc_id may have the same component_id; `component` tells them apart (null without
    a set), and text_hash the rows.
    """
    spark = docs.sparkSession
    signed = written(signatures(docs, shingle, m, half_rows), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c"), *[F.any_value(c).alias(c) for c in ("n_shingles", "a", "b")])
    n_docs = signed.count()
    nodes = written(few(nodes, n_docs, 20_000), "nodes")
    state: dict = {}

    def labelled(df: DataFrame) -> DataFrame:
        if "roots" not in state:
            return df.withColumn("comp", F.col("node"))
        return df.join(state["roots"], "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    def compared(pairs: DataFrame) -> tuple[int, int]:
        """Confirm `pairs` that have not been compared, and join what is linked: number of pairs and of links."""
        if "checked" in state:
            pairs = few(pairs.join(state["checked"], ["a", "b"], "left_anti"), each * n_docs)
        pairs = written(pairs, "pairs")
        n = pairs.count()
        if not n:
            return 0, 0
        with temporary(spark):
            links = written(_confirm(pairs, docs, nodes, shingle, percent, n), "links", outlives=1)
        new = links.count()
        state["checked"] = state["checked"].unionByName(pairs) if "checked" in state else pairs
        state["links"] = state["links"].unionByName(links) if "links" in state else links
        if new:
            state["n_links"] = state.get("n_links", 0) + new
            state["roots"] = components(state["links"], state["n_links"])
        return n, new

    # a few table keys, in turns as long as they link
    def by_few(turn: int):
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(diagonal - 1)), lambda i: F.xxhash64(i, F.get("a", i), F.get("b", (i + turn) % m)))).alias("key")

    first = nodes.select("node", by_few(0))
    often = few(first.groupBy("key").agg(F.count("*").alias("c")), diagonal * n_docs).where("c > 1")
    degrees = few(few(first.join(often, "key"), diagonal * n_docs).groupBy("node").agg(F.sum("c").alias("degree")), n_docs)
    sized = nodes.select("node", F.col("n_shingles").alias("n"), "a", "b").join(written(degrees, "degrees"), "node", "left").na.fill(0, ["degree"])
    sized = written(few(sized, n_docs, 20_000), "sized")
    n_nodes = sized.count()
    turn = 0
    while True:
        n, new = compared(_leads(labelled(sized.select("node", "n", "degree", by_few(turn))), percent, turn, n_nodes))
        turn += 1
        if not new or new < LINKED * n or n - new < LEFT * n_nodes:
            break

    # all table keys of half keys that hold more than one component, in turns as long as they link
    def side(s: int, column: str):
        return F.transform(column, lambda x, i: F.struct(F.lit(s).alias("side"), F.xxhash64(F.lit(s), i, x).alias("half")))

    sides = F.concat(side(0, "a"), side(1, "b"))
    halves = labelled(sized).select("node", "n", "degree", "comp", F.explode(sides).alias("h")).select("node", "n", "degree", "comp", "h.*")
    several = few(halves.groupBy("half").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), 2 * m * n_nodes).where("lo <> hi").select("half")
    shared = few(halves.join(several, "half"), 2 * m * n_nodes).groupBy("node", "n", "degree").agg(*[F.collect_list(F.when(F.col("side") == s, F.col("half"))).alias(c) for s, c in enumerate("ab")])
    tensor = F.flatten(F.transform("a", lambda x: F.transform(F.col("b"), lambda y: F.xxhash64(x, y))))
    keys = written(few(shared, n_nodes, 20_000).where("size(a) > 0 AND size(b) > 0").select("node", "n", "degree", F.explode(tensor).alias("key")), "keys")
    while True:
        n, new = compared(_leads(labelled(keys), percent, turn, n_nodes, each))
        turn += 1
        if not new or new < LINKED * n / each or n / each - new < LEFT * n_nodes:
            break

    # nodes of tables that still hold more than one component meet by their rarest shingles
    rows = labelled(keys)
    tables = few(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), 8 * n_nodes).where("lo <> hi").select("key")
    rest = written(few(few(rows.join(tables, "key", "left_semi"), 8 * n_nodes).select("node", "comp").distinct(), n_nodes), "rest")
    n_rest = rest.count()
    if n_rest:
        with temporary(spark):
            rare = _rarest(_sets_of(rest.select("node"), docs, nodes, shingle, n_rest), percent)
            met = written(_meeting(written(rare.join(rest, "node"), "rare"), percent), "met", outlives=1)
        compared(met)

    # the component of each node that several rows have or that is linked; any other row is one by itself
    near = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    least = nodes.select("node", "c", F.col("doc_id").alias("least"))
    if "roots" in state:
        members = state["roots"].unionByName(state["roots"].select(F.col("root").alias("node"), "root").distinct())
        members = written(few(members.join(least, "node"), n_nodes), "members")
        comps = written(few(members.groupBy("root").agg(F.min("least").alias("component_id")), n_nodes), "components")
        members = members.join(near(comps), "root").select("node", "root", "component_id")
        least = least.join(members, "node", "left").where("c > 1 OR root IS NOT NULL")
        named = least.select("node", F.coalesce("root", "node").alias("component"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    else:
        named = least.where("c > 1").select("node", F.col("node").alias("component"), F.col("least").alias("component_id"))
    named = written(few(named.withColumn("named", F.lit(True)), n_nodes), "named")
    out = signed.select("doc_id", "text_hash", "n_shingles", "node").join(near(named), "node", "left")
    component_id = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "node", F.coalesce(component_id, "doc_id").alias("component_id"), F.coalesce("component", "node").alias("component"), "text_hash")
