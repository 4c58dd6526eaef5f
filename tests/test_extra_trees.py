"""Extremely randomised trees: same seed, cuts inside their nodes, sums and scores of stored trees by SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from lumenframe.operators import explain as ex, extra_trees as et, models as md

NAMES = ["a", "b", "c"]


def frame(n=400, classes=0, seed=5):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 4, n), np.ones(n)]
    z = 3 * x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.3, n)
    y = z if not classes else np.digitize(z, np.quantile(z, np.arange(1, classes) / classes)).astype(float)
    return pd.DataFrame({"id": range(n), **dict(zip(NAMES, x.T)), "label": y})


def assembled(spark, pdf):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(spark.createDataFrame(pdf).repartition(3))


def stored(model):
    return pd.DataFrame([{"tree": t, "node": i, "feature": int(tree["feature"][i]), "cut": float(tree["cut"][i]),
                          "left_node": int(tree["left"][i]), "right_node": int(tree["right"][i]),
                          "cover": float(tree["cover"][i]), "value": float(tree["value"][i]),
                          "shares": (tree["classes"][i] / max(tree["classes"][i].sum(), 1)).tolist()}
                         for t, tree in enumerate(model.node_arrays) for i in range(len(tree["left"]))])


WALK = """WITH RECURSIVE u AS (SELECT id, 0 AS feature, a AS x FROM rows UNION ALL SELECT id, 1, b FROM rows
    UNION ALL SELECT id, 2, c FROM rows),
  w AS (SELECT id, tree, 0 AS node FROM rows, (SELECT DISTINCT tree FROM nodes)
    UNION ALL SELECT w.id, w.tree, CASE WHEN u.x <= n.cut THEN n.left_node ELSE n.right_node END
    FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN u ON u.id = w.id AND u.feature = n.feature
    WHERE n.left_node >= 0)
"""


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_stored_trees_by_sql(spark, classes):
    rows = frame(classes=classes)
    df = assembled(spark, rows)
    model = et.ExtraTrees(classes, trees=7, depth=5, seed=9).fit(df)
    nodes = stored(model)  # noqa: F841
    inside = duckdb.sql(WALK + """SELECT w.tree, w.node, count(*) AS n, avg(label) AS mean, n.cover, n.value, n.left_node,
      min(CASE n.feature WHEN 0 THEN a WHEN 1 THEN b ELSE c END) AS lo, max(CASE n.feature WHEN 0 THEN a WHEN 1 THEN b ELSE c END) AS hi,
      any_value(n.cut) AS cut FROM w JOIN rows USING (id) JOIN nodes n ON n.tree = w.tree AND n.node = w.node
      GROUP BY ALL""").fetchall()
    assert len(inside) == len(nodes)
    for _, _, n, mean, cover, value, left, lo, hi, cut in inside:
        assert n == cover
        assert left < 0 or lo <= cut < hi
        assert classes or value == pytest.approx(mean)
    own = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    if classes:
        found = duckdb.sql(WALK + """, s AS (SELECT id, unnest(n.shares) AS p, unnest(range(len(n.shares))) AS k FROM w
          JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.left_node < 0),
          t AS (SELECT id, k, sum(p) AS p FROM s GROUP BY id, k)
          SELECT id, arg_max(k, (round(p, 9), -k)) FROM t GROUP BY id""").fetchall()
        assert sum(own[i] == k for i, k in found) >= len(found) - 1 and len(found) == 400
        assert model.transform(df).filter("label = prediction").count() > 300
    else:
        found = duckdb.sql(WALK + """SELECT id, avg(n.value) FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
          WHERE n.left_node < 0 GROUP BY id""").fetchall()
        assert all(own[i] == pytest.approx(v) for i, v in found) and len(found) == 400


def test_same_seed_same_trees(spark):
    rows = frame(classes=2)
    one, two, other = (stored(et.ExtraTrees(2, 5, 4, s).fit(assembled(spark, rows.sample(frac=1, random_state=s)))) for s in (1, 1, 2))
    pd.testing.assert_frame_equal(one, two)
    assert not one.equals(other)


def test_depth_and_pure_nodes(spark):
    model = et.ExtraTrees(0, 3, 2).fit(assembled(spark, frame()))
    assert max(len(t["left"]) for t in model.node_arrays) <= 7
    flat = et.ExtraTrees(2, 3, 5).fit(assembled(spark, frame().assign(label=1.0)))
    assert all(len(t["left"]) == 1 for t in flat.node_arrays)


def test_best_of_the_drawn_cuts(spark):
    """The root's cut is the best of one drawn cut per varying column."""
    rows = frame()
    tree = et.ExtraTrees(0, 1, 1, 3).fit(assembled(spark, rows)).node_arrays[0]
    x, y = rows[NAMES].to_numpy(), rows["label"].to_numpy()
    drawn = et.drawn_cuts(0, 0, x.min(axis=0), x.max(axis=0), 3, 3)
    assert [j for j, _ in drawn] == [0, 1]

    def spread(j, cut):
        return sum(len(p) * p.var() for p in (y[x[:, j] <= cut], y[x[:, j] > cut]))
    j, cut = min(drawn, key=lambda d: spread(*d))
    assert (tree["feature"][0], tree["cut"][0]) == (j, cut)


@pytest.mark.parametrize("name,problem", [("ExtraTreesRegressor", "regression"), ("ExtraTreesClassifier", "classification")])
def test_explained(spark, name, problem):
    rng = np.random.default_rng(2)
    n = 200
    s, p = rng.uniform(20, 200, n), rng.integers(1, 6, n).astype(float)
    y = 3500 * s + 15000 * p if problem == "regression" else np.digitize(s, [80, 140])
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "surface": s, "pieces": p, "y": y}))
    found = ex.explain_model(df, "id", ["surface", "pieces"], "y", name, problem, trees=6, depth=4)
    assert found["importance"].orderBy("rank").first()["feature"] == "surface"
    if problem == "regression":
        own = {r["id"]: r["prediction"] for r in ex.predictions(found["model"], found["table"], ["surface", "pieces"]).collect()}
        assert all(abs(own[r["id"]] - r["prediction"]) < 1e-6 * abs(own[r["id"]]) for r in found["contributions"].collect())
    else:
        assert found["contributions"].select("class").distinct().count() == 3
        total = found["contributions"].groupBy("id").sum("prediction").collect()
        assert all(r["sum(prediction)"] == pytest.approx(1) for r in total)


def test_names_and_problems():
    assert md.build_explained_model("ExtraTreesRegressor", "regression", 5).classes_ == 0
    assert md.build_explained_model("ExtraTreesClassifier", "classification", 5, classes=3).classes_ == 3
    assert type(md.build_explained_model("ExtraTreesRegressor", "classification", 5)).__name__ == "RandomForestClassifier"


def test_equal_rows_are_one(spark):
    """Rows that agree in all columns are read as one: the same trees as before, with the sums of all rows."""
    from pyspark.ml.functions import vector_to_array
    rows = frame()
    many = pd.concat([rows, rows, rows], ignore_index=True)
    f = assembled(spark, many).select(vector_to_array("features").alias("f"), "label")
    merged = et.merged_rows(f, 0)
    assert merged.count() == len(rows[NAMES].drop_duplicates()) and merged.agg({"s0": "sum"}).first()[0] == len(many)
    one, three = (et.ExtraTrees(0, 3, 4, 5).fit(assembled(spark, r)).node_arrays for r in (rows, many))
    for a, b in zip(one, three):
        np.testing.assert_array_equal(a["cut"], b["cut"])
        np.testing.assert_allclose(3 * a["cover"], b["cover"])
        np.testing.assert_allclose(a["value"], b["value"])


def test_boosted_trees_of_weighted_rows(spark):
    """Boosting on one weighted row per combination of values predicts what boosting on all rows does."""
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 600).astype(float), rng.integers(0, 4, 600).astype(float)
    table = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "label": 5 * a - b + rng.normal(size=600)}))
    own = md.fit_clean_model(table, ["a", "b"], "GradientBoostingRegressor", "regression", trees=6)
    assert own.getWeightCol() == "weight"
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table)
    want = md.build_explained_model("GradientBoostingRegressor", "regression", 600, trees=6).fit(ready)
    got, expected = (m.transform(ready).orderBy("a", "b", "label").toPandas()["prediction"] for m in (own, want))
    np.testing.assert_allclose(got, expected, rtol=1e-9)
