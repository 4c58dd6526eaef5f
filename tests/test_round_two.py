"""Null keys, mixed folders, odd vectors, models with three classes, and shrinking error windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import explain as ex, models as md, ordered as od, search as vs
from lumenframe.session import scratch_path
from lumenframe.sources import files as fl
from lumenframe.streaming import events as st, sink


def test_rows_without_a_class_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "id long, quality string")
    assert md.stratified_folds(df, "id", "quality").count() == 4
    assert md.stratified_holdout(df, "id", "quality", 0.5).groupBy("quality").agg(
        F.count_if("held_out").alias("n")).orderBy("quality").collect() == [(None, 1), ("a", 1)]


def test_hot_groups_are_cut_by_their_size(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    edges = od.hot_edges(df, ["k"], "t", hot_rows=10).first()["_edges"]
    assert len(edges) == 299
    near = od.with_neighbour(df, ["k"], ["t"], F.col("t"), "next", hot_rows=10)
    assert near.filter("next = t + 1").count() == 2999 and near.filter("next IS NULL").count() == 1


def test_labels_of_many_classes(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), F.col("id")).alias("target"))
    labelled, classes = md.with_label(df, "target")
    assert len(classes) == 3000 and labelled.agg(F.max("label")).first()[0] == 2999.0


def test_a_folder_of_unlike_files(spark):
    base = scratch_path(spark, "unlike")
    rows = spark.createDataFrame([(1, "caf\u00e9"), (2, "na\u00efve")], "n int, word string")
    for i, (sep, charset) in enumerate([(",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "UTF-8"), ("|", "ISO-8859-1")]):
        rows.withColumn("n", F.col("n") + 2 * i).coalesce(1).write.option("header", True).option("sep", sep).option(
            "encoding", charset).csv(f"{base}/{i}")
    got = {r["n"]: r["word"] for r in fl.load_csv(spark, base).collect()}
    assert got == {n: "caf\u00e9" if n % 2 else "na\u00efve" for n in range(1, 9)}


def test_equal_names_in_two_folders(spark):
    listing = spark.createDataFrame([("a/x.csv", "x.csv", 5), ("b/x.csv", "x.csv", 0)], "path string, name string, size long")
    files = listing.select("path", F.lit("text/csv").alias("content_type"))
    got = {r["path"]: r["ok"] for r in fl.validate_files(files, listing).collect()}
    assert got == {"a/x.csv": True, "b/x.csv": False}


def test_search_with_text_ids_and_missing_vectors(spark):
    vectors = spark.createDataFrame([("a", None), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", [0.0, 0.0])],
                                    "id string, embedding array<float>")
    for block in (vs.BLOCK_BYTES, 1):
        got = vs.search_many(vectors, vectors, 2, block).orderBy("query_id", "position").collect()
        assert [(r["query_id"], r["id"]) for r in got] == [("b", "b"), ("b", "c"), ("c", "c"), ("c", "b")]
    model, index = vs.build_index(vectors)
    assert vs.search_index(model, index, vectors.filter("id = 'b'"), 1).first()["id"] == "b"


def test_prompts_without_source_page_or_hits(spark):
    found = spark.createDataFrame([(1, 1, None, None, "text")],
                                  "query_id long, position int, source string, page int, content string")
    questions = spark.createDataFrame([(1, "q", "en"), (2, "r", "fr")], "query_id long, question string, language string")
    got = {r["query_id"]: r["prompt"] for r in vs.prompts(found, questions).collect()}
    assert "[Source 1: inconnu, page ?]\ntext" in got[1] and "QUESTION: r" in got[2]


@pytest.mark.parametrize("name", ["logistic_regression", "lightgbm", "RandomForestClassifier"])
def test_explanations_of_three_classes(spark, name):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"),
                                 (F.col("id") % 7 % 3).cast("int").alias("target"))
    found = ex.explain_model(df, "id", ["x", "y"], "target", name, "classification", trees=3, depth=3)
    assert found["contributions"].select("class").distinct().count() == 3
    assert found["importance"].orderBy("rank").first()["feature"] == "x"
    off = found["contributions"].select(F.abs(F.col("base") + F.col("phi")[0] + F.col("phi")[1] - F.col("prediction")))
    assert off.filter(off.columns[0].join("``") + " > 1e-6").count() == 0


def test_error_windows_that_calm_down_leave(spark):
    """Errors arrive first, many good requests of the same windows in a later file."""
    base = scratch_path(spark, "requests")
    bad = spark.range(10).select(F.timestamp_seconds(F.lit(1000) + F.col("id")).alias("ts"), F.lit(500).alias("status_code"))
    good = spark.range(3000).select(F.timestamp_seconds(F.lit(1000) + F.col("id") % 10).alias("ts"),
                                    F.lit(200).alias("status_code"))
    bad.coalesce(1).write.parquet(f"{base}/1")
    good.coalesce(1).write.parquet(f"{base}/2")
    stream = spark.readStream.schema(bad.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(base)
    rows = sink.run_available(st.stream_error_ratio(stream), label="windows")
    assert rows.filter("high").count() > 0
    assert sink.latest_per_key(rows, ["tick"]).filter("high").count() == 0


@pytest.mark.parametrize("most", [0, 2, 6])
def test_leaf_tables_equal_the_paths(monkeypatch, most):
    from lumenframe.operators import explain
    monkeypatch.setattr(explain, "TABLE_FEATURES", most)
    rng = np.random.default_rng(4)
    leaves = [(rng.normal(), 0.1, np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0))]
    for _ in range(60):
        m = int(rng.integers(1, 8))
        ends = np.sort(rng.normal(size=(2, m)), axis=0)
        leaves.append((rng.normal(), 0.1, np.sort(rng.choice(9, m, replace=False)), rng.uniform(0.05, 1, m), *ends))
    x = rng.normal(size=(1300, 9))
    tables, others = explain.leaf_tables(leaves)
    assert len(others) == sum(len(leaf[2]) > most for leaf in leaves)
    found = explain.table_contributions(x, tables) + explain.path_contributions(x, others)[0]
    np.testing.assert_allclose(found, explain.path_contributions(x, leaves)[0], atol=1e-9)


def test_trees_walked_together_equal_single_walks():
    from lumenframe.operators import anomaly
    tree = {"rows": 8, "feature": np.array([0, -1, 1, -1, -1]), "cut": np.array([0.0, -1, 0.5, -1, -1]),
            "left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]),
            "path": np.array([-1, 1.0, -1, 2.5, 3.5])}
    stump = {"rows": 8, **{k: np.array([-1]) for k in ("feature", "cut", "left", "right")}, "path": np.array([4.0])}
    x = np.random.default_rng(1).normal(size=(1100, 2))
    want = np.where(x[:, 0] <= 0, 1.0, np.where(x[:, 1] <= 0.5, 2.5, 3.5))
    np.testing.assert_allclose(anomaly.mean_depth(x, anomaly.joined_trees([tree, stump, tree])), (2 * want + 4.0) / 3)
    assert len(anomaly.mean_depth(x[:0], anomaly.joined_trees([stump]))) == 0
