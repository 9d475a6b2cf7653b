"""Hand-computed cases of the library's operators."""

import pytest
from pyspark.sql import functions as F

from tandem.operators import agree, bow, items, layers, link, retrieve, scale, stats, tokens


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def cells(spark):
    data = [(0, 0, 2.0), (0, 3, 1.5), (1, 3, 0.5), (1, 6, 4.0), (2, 2, 1.0), (2, 3, 3.0)]
    return spark.createDataFrame(data, "item_id long, feature long, value double")


def test_sum_of_cells(cells):
    assert rows(bow.feature_totals(cells)) == [(0, 2.0), (2, 1.0), (3, 5.0), (6, 4.0)]


def test_concat_shifts_features(spark):
    make = lambda x: spark.createDataFrame([(0, f, float(v)) for f, v in x], "item_id long, feature long, value double")
    parts = [make([(0, 3), (2, 1)]), make([(1, 5)]), make([(0, 7), (1, 1)])]
    out = link.concat_cells(parts, [3, 4, 2])
    assert rows(out, "feature", "value") == [(0, 3), (2, 1), (4, 5), (7, 7), (8, 1)]


def test_reorder_repeats_and_rejects(spark):
    data = spark.createDataFrame([(0, "D"), (1, "E"), (2, "F"), (3, "G")], "item_id long, name string")
    mapping = spark.createDataFrame(list(enumerate([3, 0, 0, 2])), "position long, item_id long")
    out = items.reorder(data, mapping).orderBy("position").select("name").collect()
    assert "".join(r[0] for r in out) == "GDDF"
    with pytest.raises(Exception, match="unknown item"):
        items.reorder(data, spark.createDataFrame([(0, 9)], "position long, item_id long")).collect()


@pytest.mark.parametrize(("k", "expected"), [(3, [110, 70, 30]), (12, list(range(110, -1, -10))), (5, [110, 90, 70, 50, 30])])
def test_uniform_steps(spark, k, expected):
    data = spark.createDataFrame([(i, 10 * i) for i in range(12)], "position long, x long")
    assert [r["x"] for r in items.uniform_steps(data, 12, k).orderBy("step").collect()] == expected


def test_uniform_steps_rejects_more_than_there_are(spark):
    with pytest.raises(ValueError):
        items.uniform_steps(spark.range(3).withColumnRenamed("id", "position"), 3, 4)


def test_split_by_position(spark):
    out = items.split_train_devel_test(spark.range(10).withColumnRenamed("id", "position"), 10, 0.2, 0.1)
    assert [r["split"] for r in out.orderBy("position").collect()] == ["train"] * 7 + ["devel"] + ["test"] * 2


def test_runs_of_interleaved_documents(spark):
    data = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "A", 2), (1, 2, "B", 3), (1, 3, "A", 4)], "c long, i long, doc string, v long")
    out = items.aggregate_runs(data, ["c"], ["i"], "doc", {"v": "v"})
    assert rows(out, "run", "doc", "v") == [(0, "A", 3), (1, "B", 3), (2, "A", 4)]


def test_strip(spark):
    out = spark.createDataFrame([("dům_^(x)_y", "kůň-3")], "a string, b string")
    assert out.select(tokens.strip_suffix(F.col("a")), tokens.strip_sense_number(F.col("b"))).first() == ("dům", "kůň")


def test_tag_filter_and_prefix(spark):
    data = spark.createDataFrame([(0, i, 0, w, w, t) for i, (w, t) in enumerate([("a", "NN"), ("b", "AA"), ("c", "VB"), ("d", "PP"), ("e", "DT")])], "doc_id long, sent_no int, tok_no int, token string, lemma string, tag string")
    assert [r[0] for r in rows(tokens.pos_filter(data, ["N", "A", "D", "V"]), "token")] == ["a", "b", "c", "e"]
    assert [r[0] for r in rows(tokens.first_sentences(data, data, share=0.5), "token")] == ["a", "b", "c"]


def test_min_freq_keeps_a_document_that_would_be_empty(spark):
    data = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "c")], "doc_id long, token string")
    assert rows(tokens.min_doc_freq(data, 2), "doc_id", "token") == [(0, "a"), (0, "a"), (1, "c")]


def test_retrieval_metrics(spark):
    one = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "p array<string>, t array<string>, e array<string>")
    p, t, e = F.col("p"), F.col("t"), F.col("e")
    got = one.select(agree.precision(p, t), agree.recall(p, t), agree.precision(e, t), agree.recall(p, e), agree.mutual_precision(p, e)).first()
    assert tuple(got) == (0.5, 0.5, 1.0, 1.0, 0.5)


def test_unit_norms_and_sums(cells):
    unit = bow.tfidf(cells, 3)
    assert all(abs(r["n"] - 1) < 1e-9 for r in unit.groupBy("item_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect())
    assert all(abs(r["n"] - 2) < 1e-9 for r in scale.normalize_sum(cells, 2.0).groupBy("item_id").agg(F.sum("value").alias("n")).collect())


def test_capped_constant_with_an_empty_item(spark, cells):
    ids = spark.range(4).withColumnRenamed("id", "item_id")
    assert {r["value"] for r in scale.normalize_capped(cells, items=ids, strict=True).collect()} == {0.0}
    assert abs(max(r["value"] for r in scale.normalize_capped(cells, items=ids).collect()) - 0.9999) < 1e-9


def test_dense_ids_follow_the_order(spark):
    out = bow.with_ids(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")), ["x"])
    assert [r["feature"] for r in out.orderBy("x").collect()] == list(range(1000))


def test_duplicates_are_the_first_independent_set(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    out = retrieve.find_duplicates(spark.range(7).withColumnRenamed("id", "item_id"), pairs, str(tmp_path))
    assert dict(rows(out)) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}


def test_layers_invert_their_shapes(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "item_id long, vec array<double>")
    l = layers.layer([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], activation="linear", backward_activation="linear")
    assert [r["vec"] for r in layers.layer_forward(vectors, l).orderBy("item_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert [len(r["vec"]) for r in layers.stack_backward(layers.layer_forward(vectors, l), [l]).collect()] == [2, 2]


def test_empty_matrix(spark):
    empty = spark.createDataFrame([], "item_id long, feature long, value double")
    assert bow.tfidf(empty, 0 + 1).count() == 0
    assert stats.cell_histogram(empty).count() == 0
    assert scale.scale_global_max(empty).count() == 0


def test_word_vectors_of_tiny_files(spark, tmp_path):
    from tandem.sources import files

    (tmp_path / "v.txt").write_text("3 2\na 1 2\nb 3 4\na 5 6\n")
    assert rows(files.read_word_vectors(spark, str(tmp_path / "v.txt"))) == [("a", [5.0, 6.0]), ("b", [3.0, 4.0])]
    (tmp_path / "m.mm").write_text("%%MatrixMarket\n2 3 2\n1 1 0.5\n2 3 1.5\n")
    assert rows(files.read_mm(spark, str(tmp_path / "m.mm"))) == [(0, 0, 0.5), (1, 2, 1.5)]
    (tmp_path / "t.vt").write_text("A\ta\tN\nB\tb\tV\n\n\nC\tc\tN\n")
    assert rows(files.read_vtext(spark, str(tmp_path / "t.vt")), "sent_no", "tok_no", "form", "tag") == [(0, 0, "A", "N"), (0, 1, "B", "V"), (2, 0, "C", "N")]
    (tmp_path / "l.csv").write_text("t1\ti1\nt1\ti2\nt2\ti1\n")
    links = files.read_links(spark, str(tmp_path / "l.csv"))
    assert rows(files.forward_links(links)) == [("t1", ["i1", "i2"]), ("t2", ["i1"])]
    (tmp_path / "a.csv").write_text("1\tu\t60\tno\ti1;i2\t\n")
    got = files.read_annotation_outputs(spark, str(tmp_path / "a.csv")).first()
    assert (got["appropriate"], got["inappropriate"]) == (["i1", "i2"], [])
    (tmp_path / "x.csv").write_text("n1\t1;2\nn2\t3;4\n")
    assert rows(files.read_vector_csv(spark, str(tmp_path / "x.csv"), dim=2)) == [(0, "n1", [1.0, 2.0]), (1, "n2", [3.0, 4.0])]
    (tmp_path / "r.csv").write_text("q\ti1;i2\t0.5;0.25\n")
    assert rows(files.read_results(spark, str(tmp_path / "r.csv"))) == [("q", "i1", 0.5), ("q", "i2", 0.25)]


def test_stream_equals_batch(spark, tmp_path):
    """Also after a restart from the checkpoint, and after a last micro-batch that has to be run again."""
    from tandem.streaming.score import score, score_stream

    schema = "doc_id long, text string"
    idf = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "token string, idf double")
    parts = [[(1, "a b a."), (2, None), (3, "c"), (3, "c b")], [(4, "B,b a"), (4, "B,b a"), (None, "a")], [(5, "")]]
    key = lambda df: sorted(((r["doc_id"], tuple(sorted(r["weights"].items()))) for r in df.collect()), key=str)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        score_stream(stream, idf, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
        assert key(spark.read.parquet(str(tmp_path / "out"))) == key(score(spark.createDataFrame(sum(parts[: i + 1], []), schema), idf))
        if i == 1:  # as if the driver had been lost before the micro-batch was noted as done
            for f in (tmp_path / "c" / "commits").iterdir():
                if f.name.strip(".").split(".")[0] == "1":
                    f.unlink()
    got = {r["doc_id"]: r["weights"] for r in score(spark.createDataFrame(parts[0][:2], schema), idf).collect()}
    assert got == {1: {"a": 2 / 8**0.5, "b": 2 / 8**0.5}, 2: {}}


def test_kappa_counts_repeated_marks_and_certain_chance(spark):
    one = spark.createDataFrame([(["x", "x", "y"], ["x", "z"], [])], "a array<string>, b array<string>, e array<string>")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    got = one.select(agree.kappa(a, b), agree.kappa(e, e), agree.kappa(e, e, variant="cohen"), agree.kappa(a, b, variant="cohen")).first()
    # 1 common mark and 8 of neither, out of 24; chance 3/12 * 2/12 + 9/12 * 10/12; with distinct marks 1 and 9 of 12
    assert [round(x, 6) for x in got] == [-0.875, 0.0, 1.0, round((10 / 12 - 104 / 144) / (40 / 144), 6)]


def test_dense_ids_over_many_parts_and_ties(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 700).alias("x"), "id").repartition(13)
    got = bow.with_ids(rows, ["x", "id"]).orderBy("x", "id").select("feature").collect()
    assert [r[0] for r in got] == list(range(5000))


def test_matrix_market_size_line_in_any_file_order(spark, tmp_path):
    from tandem.sources import files

    (tmp_path / "a.mm").write_text("%%MatrixMarket\n9 9 40\n")
    (tmp_path / "b.mm").write_text("".join(f"{i + 1} 1 0.5\n" for i in range(40)))
    assert files.read_mm(spark, str(tmp_path)).count() == 40


def test_modes_without_a_query(spark):
    data = spark.createDataFrame([(0, 0, 0, "Aa", "NN"), (0, 0, 1, "b", "AA"), (1, 0, 0, "c", "VB")], "doc_id long, sent_no int, tok_no int, token string, tag string")
    assert [r[0] for r in rows(tokens.pos_filter(data, ["N"], inclusive=False), "token")] == ["b", "c"]
    assert [r[0] for r in rows(tokens.granularity(data, "document"), "item")] == ["0", "0", "1"]
    assert [r[0] for r in rows(tokens.granularity(data, "token"), "item")] == ["0:0:0", "0:0:1", "1:0:0"]
    marks = spark.createDataFrame([("u", 0), ("u", 30), ("u", 61), ("u", 200)], "user string, time long")
    # minutes from -1 on: 0, 0, 1, 3; in the strict form the fourth, just begun, is counted only if it begins before the end
    assert agree.time_reward(marks).first()["time_reward"] == 3.0
    assert agree.time_reward(marks.where("time < 100"), strict=True).first()["time_reward"] == 2.0
    names = spark.createDataFrame([("b",)], "token string")
    assert [r[0] for r in rows(link.include_names(data, names, "token"), "token")] == ["b"]


def test_mock_matrix_is_reproducible(spark):
    m = scale.mock_matrix(spark, 400, 20, 0.25, 2.0, seed=5)
    got = m.agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.min("value").alias("least")).first()
    assert abs(got["n"] / 8000 - 0.25) < 0.03
    assert abs(got["v"] - 3.0) < 0.2
    assert got["least"] == 1.0
    assert rows(m) == rows(scale.mock_matrix(spark, 400, 20, 0.25, 2.0, seed=5))


def test_lists_are_bounded(spark, monkeypatch):
    from tandem.sources import files

    links = spark.createDataFrame([("t", f"i{i}") for i in range(5)] + [("u", "i1")], "text_name string, image_name string")
    assert rows(files.forward_links(links))[1] == ("u", ["i1"])
    for module in (files, agree):
        monkeypatch.setattr(module, "MAX_LISTED", 4)
    with pytest.raises(ValueError, match="5 rows share one text_name"):
        files.forward_links(links)
    assert files.backward_links(links).count() == 5
    with pytest.raises(ValueError, match="5 rows share one text_name"):
        agree.group_by(links, "text_name")


def test_written_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    import os

    from tandem.operators import _shared

    monkeypatch.setattr(_shared, "shared_dir", lambda _: f"file://{tmp_path}")
    assert bow.with_ids(spark.range(9), ["id"]).count() == 9
    assert os.listdir(tmp_path)
    _shared.clear(spark)
    assert os.listdir(tmp_path) == []
