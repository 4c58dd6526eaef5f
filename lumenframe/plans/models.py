"""Registered queries of model search and explanations."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenframe.operators import explain as ex, models as md
from lumenframe.plans.inputs import view
from lumenframe.plans.shape import round_columns, rounded

CLASS_FEATURES = ["n_chars", "lang", "source"]
REGRESSION = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
NUMERIC = ["l_quantity", "l_discount", "l_tax"]

# Stated weights, so that the explanations can be checked by SQL.
WEIGHTS = {"l_quantity": 1500.0, "l_discount": -900.0, "l_tax": 250.5}
#: A stated tree: column (of NUMERIC), cut, left and right node, value.
TREE = [(0, 24.0, 1, 2, 0.0), (1, 0.05, 3, 4, 0.0), (0, 40.0, 5, 6, 0.0), (2, 0.03, 7, 8, 0.0), (0, 10.0, 9, 10, 0.0),
        (2, 0.04, 11, 12, 0.0), (0, 0.0, None, None, 90.0), (0, 0.0, None, None, 12.0), (0, 0.0, None, None, 20.5),
        (0, 0.0, None, None, 5.0), (0, 0.0, None, None, 17.0), (0, 0.0, None, None, 48.0), (0, 0.0, None, None, 61.25)]


def _classes(spark, sf):
    return view(spark, sf, "classification")


def _lines(spark, sf):
    return view(spark, sf, "regression")


def d01_prepared(spark, sf):
    rows = _classes(spark, sf)
    ready = md.preparation(rows, CLASS_FEATURES).fit(rows).transform(rows).withColumn("f", vector_to_array("features"))
    others = F.aggregate(F.slice("f", F.lit(2), F.size("f")), F.lit(0.0), lambda t, x: t + x)
    return ready.select("doc_id", F.round(F.col("f")[0], 4).alias("n_chars_scaled"), others.alias("ones"))


def d02_model_space(spark, sf):
    """Every model of the space fitted once on the whole table: (model, rows, accuracy above one half)."""
    table, classes = md.with_label(_classes(spark, sf), "quality")
    found = None
    for i in range(len(md.MODELS)):
        params = md.draw_params(i)
        model = md.train(table, CLASS_FEATURES, params, len(classes))
        one = md.accuracy(model.transform(table)).select(F.lit(params["model_name"]).alias("model"), "accuracy", "rows")
        found = one if found is None else found.unionByName(one)
    return found.select("model", "rows", (F.col("accuracy") > 0.5).alias("better_than_chance"))


def d03_folds(spark, sf):
    return md.stratified_folds(_classes(spark, sf), "doc_id", "quality").select("doc_id", "fold")


def d04_search(spark, sf):
    found = md.search(_classes(spark, sf), "doc_id", CLASS_FEATURES, "quality")
    return found.trials.select("trial", "model_name", "score", "folds", "stopped")


def d05_refit(spark, sf):
    table, classes = md.with_label(_classes(spark, sf), "quality")
    model = md.train(table, CLASS_FEATURES, {"model_name": "logistic_regression", "lr_c": 1.0}, len(classes))
    return model.transform(table).select("doc_id", "prediction")


def d06_holdout(spark, sf):
    return md.stratified_holdout(_classes(spark, sf), "doc_id", "quality").select("doc_id", "held_out")


def d06_holdout_accuracy(spark, sf):
    table, classes = md.with_label(_classes(spark, sf), "quality")
    split = md.stratified_holdout(table, "doc_id", "quality")
    model = md.train(split.filter(~F.col("held_out")), CLASS_FEATURES, {"model_name": "logistic_regression", "lr_c": 1.0},
                     len(classes))
    return md.accuracy(model.transform(split.filter("held_out")))


def _linear(spark, sf):
    return ex.linear_contributions(_lines(spark, sf), "id", WEIGHTS, 10.0)


def d07_linear_contributions(spark, sf):
    found = _linear(spark, sf)
    return found.select("id", *[F.round(F.col("phi")[i], 8).alias(c) for i, c in enumerate(WEIGHTS)],
                        F.round("prediction", 8).alias("prediction"))


def d08_tree_additivity(spark, sf):
    """Base plus contributions against the model's own prediction, for every row."""
    table = md.clean_table(_lines(spark, sf), "id", REGRESSION, "l_extendedprice", "regression")
    model = md.fit_clean_model(table, REGRESSION, "RandomForestRegressor", "regression")
    own = ex.predictions(model, table, REGRESSION).drop("features").withColumnRenamed("prediction", "own")
    found = ex.tree_contributions(model, own, "id", REGRESSION, keep=("own",))
    return found.select("id", (F.abs(F.col("own") - F.col("prediction")) < 1e-6).alias("additive"))


def d08_tree_contributions(spark, sf):
    """Contributions of a stated tree, whose covers are counted in the data."""
    rows = _lines(spark, sf).select("id", *NUMERIC)
    paths = [F.lit(True)]
    nodes: list = [None] * len(TREE)

    def visit(i, where):
        nodes[i] = where
        feature, cut, left, right, _ = TREE[i]
        if left is not None:
            visit(left, where & (F.col(NUMERIC[feature]) <= cut))
            visit(right, where & (F.col(NUMERIC[feature]) > cut))
    visit(0, paths[0])
    cover = rows.agg(*[F.count_if(w).alias(f"c{i}") for i, w in enumerate(nodes)]).first()
    tree = {"feature": np.array([n[0] for n in TREE]), "cut": np.array([n[1] for n in TREE]),
            "left": np.array([-1 if n[2] is None else n[2] for n in TREE]),
            "right": np.array([-1 if n[3] is None else n[3] for n in TREE]),
            "cover": np.array([float(cover[f"c{i}"]) for i in range(len(TREE))])}
    leaves = ex.leaf_paths(tree, np.array([n[4] for n in TREE]))
    found = ex.leaf_contributions(leaves, rows, "id", NUMERIC)
    return found.select("id", *[F.round(F.col("phi")[i], 6).alias(c) for i, c in enumerate(NUMERIC)],
                        F.round("base", 6).alias("base"), F.round("prediction", 6).alias("prediction"))


def d09_importance(spark, sf):
    return ex.global_importance(_linear(spark, sf), list(WEIGHTS))


def d09_class_importance(spark, sf):
    """A forest over the document classes: mean over both classes."""
    table = md.clean_table(_classes(spark, sf), "doc_id", CLASS_FEATURES, "quality", "classification")
    model = md.fit_clean_model(table, CLASS_FEATURES, "RandomForestClassifier", "classification")
    frames = [ex.tree_contributions(model, table, "doc_id", CLASS_FEATURES, output=i) for i in range(2)]
    return ex.mean_over_classes(frames, CLASS_FEATURES)


def _local(spark, sf):
    """The first rows by key; equal keys are told apart by their values."""
    rows = _lines(spark, sf).groupBy("id").agg(*[F.max(c).alias(c) for c in NUMERIC])
    return ex.local_explanations(ex.linear_contributions(rows, "id", WEIGHTS, 10.0), "id", list(WEIGHTS))


def d10_local_explanations(spark, sf):
    return round_columns(_local(spark, sf), "value")


def d11_clean_refit(spark, sf):
    """Ridge, lasso, elastic net, boosted and extremely randomised trees on the same clean table: how much variance each
    explains."""
    table = md.clean_table(_lines(spark, sf), "id", REGRESSION, "l_extendedprice", "regression")
    found = None
    for name in ("Ridge", "Lasso", "ElasticNet", "GradientBoostingRegressor", "ExtraTreesRegressor"):
        model = md.fit_clean_model(table, REGRESSION, name, "regression")
        fitted = ex.predictions(model, table, REGRESSION)
        r2 = 1 - F.sum(F.pow(F.col("label") - F.col("prediction"), F.lit(2.0))) / (
            F.var_pop("label") * F.count(F.lit(1)))
        one = fitted.agg(r2.alias("r2"), F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("model"), "r2", "rows")
        found = one if found is None else found.unionByName(one)
    return found


def d12_importance_summary(spark, sf):
    return ex.importance_summary(d09_importance(spark, sf))


def d13_importance_bars(spark, sf):
    return ex.importance_bars(d09_importance(spark, sf))


def d14_waterfall(spark, sf):
    return round_columns(ex.waterfall(_local(spark, sf), "id"), "total", "value")


def d15_force_data(spark, sf):
    data = ex.force_data(_local(spark, sf), "id")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("decimal(20,4)").cast("string")), ",")
    return data.select("id", rounded("base_value"), text("shap_values").alias("shap_values"), text("data").alias("data"),
                       F.array_join("feature_names", ",").alias("feature_names"), rounded("prediction"))


_MD5 = "md5(doc_id || '-42')"
_POS = f"""pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {_MD5}, doc_id) AS p,
  COUNT(*) OVER (PARTITION BY quality) AS n FROM classification)"""
_MEANS = "mu AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}" for c in WEIGHTS) + " FROM {src})"
_PHI = "phi AS (SELECT id, " + ", ".join(f"{c}, {w} * ({c} - m_{c}) AS p_{c}" for c, w in WEIGHTS.items()) + ", 10.0 + " + \
    " + ".join(f"{w} * {c}" for c, w in WEIGHTS.items()) + " AS prediction FROM {src}, mu)"
_LINEAR = (_MEANS + ", " + _PHI).replace("{src}", "regression")
_IMP = _LINEAR + ", raw AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS feature, AVG(ABS(p_{c})) AS v FROM phi" for i, c in enumerate(WEIGHTS)) + """),
imp AS (SELECT ROW_NUMBER() OVER (ORDER BY ROUND(v, 4) DESC, i) AS rank, feature, ROUND(v, 4) AS importance,
  ROUND(v / SUM(v) OVER () * 100, 2) AS importance_percentage FROM raw)"""
_LOC = ("one AS (SELECT id, " + ", ".join(f"MAX({c}) AS {c}" for c in WEIGHTS) + " FROM regression GROUP BY id), "
        + (_MEANS + ", " + _PHI).replace("{src}", "one") + """, three AS (SELECT * FROM phi ORDER BY id LIMIT 3),
flat AS (""" + " UNION ALL ".join(
    f"SELECT id, {i} AS i, '{c}' AS feature, {c} AS value, p_{c} AS p, prediction FROM three"
    for i, c in enumerate(WEIGHTS)) + """),
loc AS (SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY ABS(p) DESC, i) AS INTEGER) AS position, feature,
  ROUND(value, 4) AS value, ROUND(p, 4) AS shap_contribution, CASE WHEN p > 0 THEN 'positive' ELSE 'negative' END
  AS direction, ROUND(prediction, 4) AS prediction, ROUND((SELECT AVG(prediction) FROM phi), 4) AS baseline FROM flat)""")



def _covers() -> str:
    """Share of the rows of each node, of its parent's."""
    where = ["TRUE"] * len(TREE)
    for i, (feature, cut, left, right, _) in enumerate(TREE):
        if left is not None:
            where[left] = f"{where[i]} AND {NUMERIC[feature]} <= {cut}"
            where[right] = f"{where[i]} AND {NUMERIC[feature]} > {cut}"
    return "cov AS (SELECT " + ", ".join(f"count(*) FILTER ({w})::DOUBLE AS c{i}" for i, w in enumerate(where)) + " FROM regression)"


def _expected(i: int, known: tuple[int, ...]) -> str:
    """Mean of the tree below node ``i`` for a row whose columns ``known`` are given."""
    feature, cut, left, right, value = TREE[i]
    if left is None:
        return f"{value}::DOUBLE"
    a, b = _expected(left, known), _expected(right, known)
    if feature in known:
        return f"CASE WHEN {NUMERIC[feature]} <= {cut} THEN {a} ELSE {b} END"
    return f"(c{left} * {a} + c{right} * {b}) / c{i}"


def _enumerated() -> str:
    """Shapley values by enumeration of all subsets of the columns."""
    d = len(NUMERIC)
    subsets = [s for n in range(d + 1) for s in itertools.combinations(range(d), n)]
    name = lambda s: "v" + "".join(map(str, s))
    parts = []
    for f in range(d):
        terms = [f"{math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)!r} * ("
                 f"{name(tuple(sorted((*s, f))))} - {name(s)})" for s in subsets if f not in s]
        parts.append(f"ROUND({' + '.join(terms)}, 6) AS {NUMERIC[f]}")
    return (f"WITH {_covers()}, e AS (SELECT id, " + ", ".join(f"{_expected(0, s)} AS {name(s)}" for s in subsets)
            + " FROM regression, cov) SELECT id, " + ", ".join(parts)
            + f", ROUND(v, 6) AS base, ROUND({name(tuple(range(d)))}, 6) AS prediction FROM e")


SQL = {
    "d01_prepared": """SELECT doc_id, ROUND((n_chars - AVG(n_chars) OVER ()) / STDDEV_POP(n_chars) OVER (), 4) + 0.0
  AS n_chars_scaled, 2.0::DOUBLE AS ones FROM classification""",
    "d02_model_space": " UNION ALL ".join(
        f"SELECT '{m}' AS model, (SELECT COUNT(*) FROM classification) AS rows, true AS better_than_chance"
        for m in md.MODELS),
    "d03_folds": f"WITH {_POS} SELECT doc_id, CAST((p - 1) % 5 AS INTEGER) AS fold FROM pos",
    "d06_holdout": f"WITH {_POS} SELECT doc_id, p <= ROUND(n * 0.2) AS held_out FROM pos",
    "d07_linear_contributions": f"WITH {_LINEAR} SELECT id, " + ", ".join(
        f"ROUND(p_{c}, 8) AS {c}" for c in WEIGHTS) + ", ROUND(prediction, 8) AS prediction FROM phi",
    "d08_tree_additivity": "SELECT id, true AS additive FROM regression",
    "d08_tree_contributions": _enumerated(),
    "d09_importance": f"WITH {_IMP} SELECT CAST(rank AS INTEGER) AS rank, feature, importance, importance_percentage FROM imp",
    "d10_local_explanations": f"WITH {_LOC} SELECT * FROM loc",
    "d12_importance_summary": f"""WITH {_IMP} SELECT COUNT(*) AS total_features, ROUND(AVG(importance), 4) AS mean_importance,
  ROUND(MEDIAN(importance), 4) AS median_importance, ROUND(STDDEV_POP(importance), 4) AS std_importance,
  string_agg(feature, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS top_3_features,
  ROUND(SUM(importance) FILTER (WHERE rank <= 3) / SUM(importance) * 100, 1) AS top_3_coverage_percent,
  MAX(CASE WHEN rank = 1 THEN feature END) AS top_feature FROM imp""",
    "d13_importance_bars": f"""WITH {_IMP} SELECT CAST(rank AS INTEGER) AS rank, feature, importance_percentage,
  CAST(CAST(ROUND(importance_percentage, 1) AS DECIMAL(10,1)) AS VARCHAR) || '%' AS label FROM imp WHERE rank <= 10""",
    "d14_waterfall": f"""WITH {_LOC} SELECT id, 0 AS position, 'Baseline' AS label, 0.0::DOUBLE AS value, 'total' AS measure,
  baseline AS total, 'blue' AS color FROM loc WHERE position = 1
UNION ALL SELECT id, position, feature, shap_contribution, 'relative', ROUND(baseline + SUM(shap_contribution)
  OVER (PARTITION BY id ORDER BY position), 4), CASE WHEN shap_contribution > 0 THEN 'green' ELSE 'red' END
  FROM loc WHERE position <= 5
UNION ALL SELECT id, 6, 'Prediction', 0.0, 'total', prediction, 'darkgreen' FROM loc WHERE position = 1""",
    "d15_force_data": f"""WITH {_LOC} SELECT id, MAX(baseline) AS base_value,
  string_agg(CAST(CAST(shap_contribution AS DECIMAL(20,4)) AS VARCHAR), ',' ORDER BY position) AS shap_values,
  string_agg(CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR), ',' ORDER BY position) AS data,
  string_agg(feature, ',' ORDER BY position) AS feature_names, MAX(prediction) AS prediction FROM loc GROUP BY id""",
}

QUERIES = [d01_prepared, d02_model_space, d03_folds, d04_search, d05_refit, d06_holdout, d06_holdout_accuracy,
           d07_linear_contributions, d08_tree_additivity, d08_tree_contributions, d09_importance, d09_class_importance, d10_local_explanations,
           d11_clean_refit, d12_importance_summary, d13_importance_bars, d14_waterfall, d15_force_data]
