"""Model search and explanations: thresholds, additivity, brute-force Shapley values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import explain as ex, models as md


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(7)
    n = 260
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.choice(["x", "y", "z"], n)
    logit = 1.4 * a - 0.9 * b + 0.8 * (c == "x") + rng.normal(0, 0.3, n)
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c, "y": (logit > 0).astype(int)}))


def test_search_beats_the_floor(binary):
    found = md.search(binary, "id", ["a", "b", "c"], "y", trials=4, folds=3, max_trees=6)
    assert found.best_score >= 0.65
    assert sorted(r["model_name"] for r in found.trials.collect()) == sorted(md.MODELS)
    assert all(0 <= r["score"] <= 1 for r in found.trials.collect())


def test_folds_and_holdout_are_stratified(binary):
    folds = md.stratified_folds(binary, "id", "y").groupBy("y", "fold").count().toPandas()
    assert folds.groupby("y")["count"].agg(lambda c: c.max() - c.min()).max() <= 1
    held = md.stratified_holdout(binary, "id", "y").groupBy("y").agg(
        F.avg(F.col("held_out").cast("int")).alias("share")).collect()
    assert all(abs(r["share"] - 0.2) < 0.01 for r in held)


def test_unknown_model_name_is_refused():
    with pytest.raises(ValueError):
        md.build_classifier({"model_name": "svm"})


@pytest.mark.parametrize("params,kind", [
    ({"model_name": "random_forest", "rf_n_estimators": 10, "rf_max_depth": 3}, "BinnedTrees"),
    ({"model_name": "lightgbm", "lgbm_learning_rate": 0.1, "lgbm_n_estimators": 10}, "BinnedTrees"),
    ({"model_name": "xgboost", "xgb_n_estimators": 10, "xgb_max_depth": 3, "xgb_learning_rate": 0.1}, "BinnedTrees"),
    ({"model_name": "logistic_regression", "lr_c": 1.0}, "LogisticRegression")])
def test_params_map_to_models(spark, params, kind):
    built = md.build_classifier(params)
    assert type(built).__name__ == kind
    assert kind != "BinnedTrees" or built.params_ == params


def test_unseen_value_sets_no_column(spark, binary):
    ready = md.preparation(binary, ["a", "c"]).fit(binary)
    assert ready.feature_names == ["a", "c_x", "c_y", "c_z"]
    other = spark.createDataFrame([(0.0, "new"), (None, None)], "a double, c string")
    rows = [r["features"].toArray() for r in ready.transform(other).collect()]
    assert rows[0][1:].sum() == 0 and rows[1][1:].sum() == 1


def shapley(trees, x, d):
    """Shapley values by enumeration, expectation along the tree's own cover."""
    def value(i, tree, known):
        if tree["left"][i] < 0:
            return tree["v"][i]
        f, left, right = tree["feature"][i], tree["left"][i], tree["right"][i]
        if f in known:
            return value(left if x[f] <= tree["cut"][i] else right, tree, known)
        c = tree["cover"]
        return (c[left] * value(left, tree, known) + c[right] * value(right, tree, known)) / c[i]

    phi = np.zeros(d)
    for f in range(d):
        others = [g for g in range(d) if g != f]
        for size in range(d):
            weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            for known in itertools.combinations(others, size):
                for tree in trees:
                    phi[f] += weight * (value(0, tree, {*known, f}) - value(0, tree, set(known)))
    return phi


@pytest.mark.parametrize("name", ["RandomForestRegressor", "GradientBoostingRegressor"])
def test_tree_contributions_equal_enumeration(spark, name):
    rng = np.random.default_rng(11)
    n = 300
    s, p, t = rng.uniform(20, 200, n), rng.integers(1, 6, n).astype(float), rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "surface": s, "pieces": p, "t": t,
                                             "prix": 3500 * s + 15000 * p + rng.normal(0, 5000, n)}))
    names = ["surface", "pieces", "t"]
    found = ex.explain_model(df, "id", names, "prix", name, trees=4, depth=4)
    trees, weights = ex.tree_nodes(found["model"])
    trees = [{**tree, "v": tree["value"] * w} for tree, w in zip(trees, weights)]
    for r in found["contributions"].orderBy("id").limit(8).collect():
        np.testing.assert_allclose(r["phi"], shapley(trees, r["x"], 3), rtol=1e-8, atol=1e-6)
    assert found["importance"].orderBy("rank").first()["feature"] == "surface"
    own = {r["id"]: r["prediction"] for r in ex.predictions(found["model"], found["table"], names).collect()}
    assert all(abs(own[r["id"]] - r["prediction"]) < 1e-5 * abs(own[r["id"]]) for r in found["contributions"].collect())
    local = found["local"].toPandas()
    assert len(local) == 9 and set(local["direction"]) <= {"positive", "negative"}


def test_linear_explanation_adds_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), 2.0 * i - 5.0 * (i % 3)) for i in range(60)],
                               "id long, a double, b double, y double")
    found = ex.explain_model(df, "id", ["a", "b"], "y", "Ridge")
    rows = found["contributions"].collect()
    assert all(abs(sum(r["phi"]) + r["base"] - r["prediction"]) < 1e-9 for r in rows)
    bars = ex.importance_bars(found["importance"]).collect()
    assert bars[0]["label"].endswith("%")
    steps = ex.waterfall(found["local"], "id").filter("id = 0").orderBy("position").collect()
    assert [s["label"] for s in steps][0] == "Baseline" and steps[-1]["label"] == "Prediction"


def test_no_features_is_an_error(spark):
    with pytest.raises(ValueError):
        ex.explain_model(spark.range(3), "id", [], "id")
