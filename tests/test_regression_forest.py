"""Regression forests: every node against its rows, and the best cut against brute force."""

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler

from lumenframe.operators import models as md, regression_forest as rf


def assembled(spark, rows):
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows))


def frame(n=900):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 12, n).astype(float), rng.integers(0, 5, n).astype(float), np.ones(n)
    return pd.DataFrame({"a": a, "b": b, "c": c, "label": 10.0 * a + 3 * (b > 2) + rng.normal(size=n)})


def test_trees_grow_on_cells_of_drawn_rows(spark):
    rows = frame()
    df = assembled(spark, rows)
    model = md.build_explained_model("RandomForestRegressor", "regression", len(rows), trees=12, depth=5).fit(df)
    assert len(model.node_arrays) == 12
    for t in model.node_arrays:
        inner = np.flatnonzero(t["left"] >= 0)
        assert len(inner) and len(t["left"]) < 64
        np.testing.assert_allclose(t["cover"][t["left"][inner]] + t["cover"][t["right"][inner]], t["cover"][inner])
        np.testing.assert_allclose(t["cover"][inner] * t["value"][inner], sum(
            t["cover"][t[s][inner]] * t["value"][t[s][inner]] for s in ("left", "right")))
        assert abs(t["cover"][0] - len(rows)) < 6 * len(rows) ** 0.5 and t["cover"][0] == round(t["cover"][0])
    assert len({float(t["cover"][0]) for t in model.node_arrays}) > 6  # samples of their own
    found = model.transform(df).toPandas()
    assert ((found["prediction"] - found["label"]) ** 2).mean() < 0.1 * rows["label"].var()


def test_cut_of_least_squares():
    rng = np.random.default_rng(8)
    bins = np.unique(rng.integers(0, 9, (60, 1)), axis=0).astype(np.uint8)
    edges = [np.arange(8.0)]
    n = rng.poisson(3.0, len(bins)).astype(float)
    s = rng.normal(size=len(bins)) * n
    tree = rf.grow(bins, n, s, edges, 1, np.random.default_rng(0))

    def kept(cut):
        low = bins[:, 0] <= cut
        return sum(s[p].sum() ** 2 / n[p].sum() for p in (low, ~low) if n[p].sum())
    assert tree["cut"][0] == max(edges[0], key=kept)
    assert tree["cover"][0] == n.sum() and len(tree["left"]) == 3


def test_too_many_cells_are_left_to_spark(spark):
    df = assembled(spark, frame(200))
    model = rf.RegressionForest(3, 4, most_cells=5).fit(df)
    assert model.getNumTrees == 3
    one = rf.RegressionForest(4, 3).fit(assembled(spark, frame(1)))
    assert all(len(t["left"]) == 1 for t in one.node_arrays)
