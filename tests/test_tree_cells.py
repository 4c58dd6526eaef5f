"""Cells between the cuts of trees: rows that share one are worked out once and get what each would get alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumenframe.operators import anomaly, explain as ex, extra_trees as et, regression_forest as rf, tree_cells as tc

TREE = {"feature": np.array([0, 1, 0, 0, 0]), "cut": np.array([1.5, 2.5, 0.0, 0.0, 0.0]), "left": np.array([1, 3, -1, -1, -1]),
        "right": np.array([2, 4, -1, -1, -1]), "cover": np.array([10.0, 6, 4, 2, 4]), "value": np.array([0.0, 0, 1, 2, 3]),
        "classes": np.zeros((5, 0))}


def test_values_are_asked_once_per_cell():
    asked = []

    def value(x):
        asked.extend(map(tuple, x))
        return (x > [1.0, 2.0]) @ [10.0, 1.0]

    rng = np.random.default_rng(2)
    found = tc.CellValues([np.array([1.0]), np.array([2.0])], value)
    for _ in range(5):
        x = np.round(rng.uniform(0, 4, (400, 2)), 1)
        np.testing.assert_array_equal(found(x), (x > [1.0, 2.0]) @ [10.0, 1.0])
    assert len(asked) == 4
    few = tc.CellValues([np.array([1.0]), np.array([2.0])], value, most=1)
    np.testing.assert_array_equal(few(x), (x > [1.0, 2.0]) @ [10.0, 1.0])
    assert not len(few.kept)
    wide = [np.arange(float(1 << 12))] * 6  # too many cells to be numbered
    np.testing.assert_array_equal(tc.CellValues(wide, lambda x: x.sum(axis=1))(np.ones((3, 6))), [6.0] * 3)


def test_a_model_predicts_by_cells_what_its_trees_say(spark):
    rows = pd.DataFrame({"a": np.arange(40_000) % 7 / 2, "b": np.arange(40_000) % 5, "c": 1.0})
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows).coalesce(1))
    model = et.ExtraTreesModel([TREE, TREE], 0)
    own = model.transform(df).select("a", "b", "prediction").toPandas()
    want = np.where(own["a"] > 1.5, 1.0, np.where(own["b"] <= 2.5, 2.0, 3.0))
    np.testing.assert_array_equal(own["prediction"], want)
    stump = et.ExtraTreesModel([{**{k: v[2:3] for k, v in TREE.items()}, "left": np.array([-1])}], 0)
    assert stump.transform(df.limit(3)).agg(F.min("prediction")).first()[0] == 1.0


@pytest.mark.parametrize("cells", [None, True, False])
def test_rows_get_the_contributions_of_their_cell(spark, cells, monkeypatch):
    rows = [(i, a, b) for i, (a, b) in enumerate([(1.0, 2.0), (None, 3.0), (float("nan"), 1.0), (2.0, None), (2.0, None)])]
    df = spark.createDataFrame([*rows, (None, 1.5, 2.5), (4, 2.0, 9.0)], "id long, a double, b double")
    df = df.withColumn("own", F.col("b"))
    leaves = ex.leaf_paths(TREE, TREE["value"])

    def found():
        return sorted(((r["id"] is None, r["id"], r["x"], r["own"], r["phi"], r["base"], r["prediction"]) for r in
                       ex.leaf_contributions(leaves, df, "id", ["a", "b"], ("own",), cells).collect()), key=repr)
    sent = found()
    assert len(sent) == 7 and sum(r[1] == 4 for r in sent) == 2
    for r in sent:
        x = np.array([[np.nan if v is None else v for v in r[2]]])
        np.testing.assert_allclose(r[4], ex.path_contributions(x, leaves)[0][0], atol=1e-12)
    monkeypatch.setattr(ex, "SENT_NUMBERS", 0)  # by a shuffle
    assert found() == sent
    monkeypatch.setattr(ex, "NUMBERS", 0)  # cells named by their places
    assert found() == sent


def test_cells_are_explained_without_the_carried_columns(spark):
    """A costly column that is only carried is worked out once per row, not again to tell the cells apart."""
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        count.add(1)
        return x

    df = spark.range(500).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("own", costly.asNondeterministic()("a"))
    found = ex.leaf_contributions(ex.leaf_paths(TREE, TREE["value"]), df, "id", ["a", "b"], ("own",))
    assert found.agg(F.sum("own"), F.sum("prediction")).first()[0] == 750.0
    assert count.value == 500


def test_poisson_numbers():
    drawn = np.concatenate([rf.poisson_numbers(np.random.default_rng(i), rf.BLOCK) for i in range(20)])
    for k, share in enumerate(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120])):
        assert abs((drawn == k).mean() - share) < 5 * (share / len(drawn)) ** 0.5
    assert abs(np.corrcoef(drawn[:-1], drawn[1:])[0, 1]) < 0.005 and len(rf.poisson_numbers(np.random.default_rng(0), 7)) == 7


def test_edges_of_distinct_rows_equal_those_of_all_rows(spark):
    from lumenframe.operators.boosting import bin_edges
    rng = np.random.default_rng(9)
    values = np.stack([rng.integers(0, 40, 3000), rng.integers(0, 900, 3000) ** 2], axis=1).astype(float)
    rows = spark.createDataFrame(pd.DataFrame(values, columns=["f0", "f1"]))
    columns, n = rf.met_rows(rows, ["f0", "f1"], 1 << 18)
    assert n.sum() == 3000 and len(n) == len(np.unique(values, axis=0))
    for own, want in zip(columns, bin_edges(rows.select(F.array("f0", "f1").alias("f")))[()]):
        np.testing.assert_array_equal(rf.weighted_edges(own, n), want)
    assert rf.met_rows(rows, ["f0", "f1"], 500) is None


def test_trees_are_the_same_by_distinct_rows_and_by_sketch(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"a": rng.integers(0, 12, 900).astype(float), "b": rng.integers(0, 5, 900).astype(float)})
    rows["label"] = 10.0 * rows["a"] + rng.normal(size=900)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows).coalesce(2))
    own = rf.RegressionForest(5, 4).fit(df).node_arrays
    monkeypatch.setattr(rf, "met_rows", lambda *_: None)
    for a, b in zip(own, rf.RegressionForest(5, 4).fit(df).node_arrays):
        for k in rf.NODE:
            np.testing.assert_array_equal(a[k], b[k])


def test_only_columns_with_gaps_need_a_median(spark, monkeypatch):
    asked = []
    known = anomaly.quantile_map
    monkeypatch.setattr(anomaly, "quantile_map", lambda df, columns, *a, **k: asked.extend(columns) or known(df, columns, *a, **k))
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, None, None), (3.0, 5.0, None)], "a double, b double, c double")
    found = anomaly.impute(df, ["a", "b", "c"]).orderBy("a").collect()
    assert [tuple(r) for r in found] == [(1.0, 1.0, 0.0), (2.0, 3.0, 0.0), (3.0, 5.0, 0.0)]
    assert asked == ["b", "c"]
