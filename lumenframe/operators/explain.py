"""Additive explanations of predictions, and the data behind their charts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel, OneVsRestModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lumenframe.operators.models import clean_table, fit_clean_model
from lumenframe.operators.quantiles import number
from lumenframe.operators.tree_cells import NUMBERS, cell_count, cell_numbers, cell_places
from lumenframe.session import materialise, scratch_path

LOCAL_ROWS = 3
#: Leaves of up to so many features get a table of contributions; one has ``2 ** TABLE_FEATURES`` rows at most.
TABLE_FEATURES = 6
#: Rows and leaves that are worked on at once, so that the arrays stay in the processor's cache.
TABLE_ROWS, TABLE_LEAVES = 256, 256
#: Cells are sent to all tasks if their contributions can't be more numbers than this (32 MB).
SENT_NUMBERS = 1 << 22
TOP_BARS, TOP_STEPS = 10, 5


# Contributions -------------------------------------------------------------------------------------------------

def linear_contributions(table: DataFrame, key: str, coefficients: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """``(key, phi, base, prediction)``: coefficient times distance from the column mean."""
    features = list(coefficients)
    means = table.agg(*[F.avg(c).alias(c) for c in features]).first()
    phi = F.array(*[F.lit(float(coefficients[c])) * (F.col(c) - F.lit(means[c])) for c in features])
    base = intercept + sum(coefficients[c] * means[c] for c in features)
    prediction = sum((F.lit(float(coefficients[c])) * F.col(c) for c in features), F.lit(float(intercept)))
    return table.select(key, F.array(*features).cast("array<double>").alias("x"), phi.alias("phi"),
                        F.lit(float(base)).alias("base"), prediction.alias("prediction"))


def tree_nodes(model) -> tuple[list[dict], list[float]]:
    """Nodes of every tree as arrays, and the weight of each tree. The size of a model bounds what is read."""
    if hasattr(model, "node_arrays"):
        return model.node_arrays, [1.0 / len(model.node_arrays)] * len(model.node_arrays)
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()
    ensemble = hasattr(model, "treeWeights")
    weights = list(model.treeWeights) if ensemble else [1.0]
    if ensemble and "RandomForest" in type(model).__name__:
        weights = [1.0 / len(weights)] * len(weights)
    by_tree: dict = {}
    for r in rows:
        row = r.asDict(recursive=True)
        by_tree.setdefault(row.get("treeID", 0), []).append(row.get("nodeData", row))
    trees = []
    for _, nodes in sorted(by_tree.items()):
        nodes = sorted(nodes, key=lambda n: n["id"])
        trees.append({
            "feature": np.array([n["split"]["featureIndex"] for n in nodes]),
            "cut": np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in nodes]),
            "left": np.array([n["leftChild"] for n in nodes]), "right": np.array([n["rightChild"] for n in nodes]),
            "cover": np.array([float(n["rawCount"]) for n in nodes]),
            "value": np.array([n["prediction"] for n in nodes]),
            "classes": np.array([n["impurityStats"] for n in nodes])})
    return trees, weights


def leaf_paths(tree: dict, values: np.ndarray) -> list[tuple]:
    """Per leaf: its value, its distinct features, their cover shares and the interval each must lie in."""
    found = []

    def walk(i: int, path: dict, weight: float):
        if tree["left"][i] < 0:
            items = sorted(path.items())
            found.append((values[i], weight, np.array([f for f, _ in items], dtype=int),
                          np.array([p[0] for _, p in items]), np.array([p[1] for _, p in items]),
                          np.array([p[2] for _, p in items])))
            return
        f, cut = int(tree["feature"][i]), float(tree["cut"][i])
        share, low, high = path.get(f, (1.0, -np.inf, np.inf))
        for child, a, b in ((tree["left"][i], low, min(high, cut)), (tree["right"][i], max(low, cut), high)):
            part = tree["cover"][child] / tree["cover"][i]
            walk(int(child), {**path, f: (share * part, a, b)}, weight * part)

    walk(0, {}, 1.0)
    return found


def path_contributions(x: np.ndarray, leaves: list[tuple]) -> tuple[np.ndarray, float]:
    """Contributions of one tree for all rows of ``x``.

    The permutation weights of a leaf with m features equal the integral over u in 0..1 of the product of
    ``u * hot + (1 - u) * share`` over the other features. It is a polynomial of degree m - 1, so Gauss-Legendre
    points give it exactly, for all rows at once.
    """
    phi, base = np.zeros(x.shape), 0.0
    for value, weight, features, share, low, high in leaves:
        base += value * weight
        m = len(features)
        if not m:
            continue
        part = x[:, features]
        hot = ((part > low) & (part <= high)).astype(float)
        points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        total = np.zeros(part.shape)
        for u, w in zip((points + 1) / 2, weights / 2):
            mixed = u * hot + (1 - u) * share
            total += w * mixed.prod(axis=1, keepdims=True) / mixed
        phi[:, features] += value * (hot - share) * total
    return phi, base


def leaf_tables(leaves: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Leaves of few features as tables, grouped by their features, and the leaves of many features as they are.

    What a leaf adds depends only on which of its features lie in their intervals. A group holds the features, the
    intervals' ends and, per feature, its contribution for each leaf and combination of features.
    """
    groups: dict = {}
    for leaf in leaves:
        if 0 < len(leaf[2]) <= TABLE_FEATURES:
            groups.setdefault(tuple(leaf[2].tolist()), []).append(leaf)
    tables = []
    parts = [(features, own[i:i + TABLE_LEAVES]) for features, own in groups.items()
             for i in range(0, len(own), TABLE_LEAVES)]
    for features, own in parts:
        m = len(features)
        value, share = np.array([leaf[0] for leaf in own]), np.array([leaf[3] for leaf in own])
        hot = (np.arange(2 ** m)[:, None] >> np.arange(m) & 1).astype(float)
        points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        total = np.zeros((len(own), 2 ** m, m))
        for u, w in zip((points + 1) / 2, weights / 2):
            mixed = u * hot[None] + (1 - u) * share[:, None, :]
            total += w * mixed.prod(axis=2, keepdims=True) / mixed
        added = value[:, None, None] * (hot[None] - share[:, None, :]) * total
        tables.append((features, np.array([leaf[4] for leaf in own]).T.copy(), np.array([leaf[5] for leaf in own]).T.copy(),
                       added.reshape(-1, m).T.copy()))
    return tables, [leaf for leaf in leaves if len(leaf[2]) > TABLE_FEATURES]


def table_contributions(x: np.ndarray, tables: list[tuple]) -> np.ndarray:
    """Summed contributions of grouped leaves for all rows of ``x``, block by block."""
    phi = np.zeros(x.shape)
    for start in range(0, len(x), TABLE_ROWS):
        part = x[start:start + TABLE_ROWS]
        for features, low, high, added in tables:
            held = np.zeros((len(part), low.shape[1]), dtype=np.uint8)
            for j, f in enumerate(features):
                value = part[:, f, None]
                held |= ((value > low[j]) & (value <= high[j])).view(np.uint8) << np.uint8(j)
            at = held + np.arange(low.shape[1], dtype=np.intp) * 2 ** len(features)
            for j, f in enumerate(features):
                phi[start:start + TABLE_ROWS, f] += added[j].take(at).sum(axis=1)
    return phi


def forest_leaves(model, output: int = 1) -> list[tuple]:
    """The leaves of all trees of an ensemble; ``output`` picks the class of a forest."""
    trees, weights = tree_nodes(model)
    forest_classes = ("RandomForestClassif" in type(model).__name__ or "DecisionTreeClassif" in type(model).__name__
                      or getattr(model, "classes_", 0) > 0)
    leaves = []
    for tree, weight in zip(trees, weights):
        value = tree["value"]
        if forest_classes:
            value = tree["classes"][:, output] / tree["classes"].sum(axis=1)
        leaves += leaf_paths(tree, value * weight)
    return leaves


def all_cuts(leaves: list[tuple], columns: int) -> list[np.ndarray]:
    """Per column all places at which some tree cuts it."""
    ends: list[list] = [[] for _ in range(columns)]
    for _, _, features, _, low, high in leaves:
        for f, a, b in zip(features, low, high):
            ends[f] += [a, b]
    return [np.unique([e for e in own if np.isfinite(e)]) for own in ends]


def _without_nan(table: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    kind = table.schema[name].dataType
    return (F.nanvl(F.col(name), F.lit(None).cast(kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(name)).alias(name)


def cell_column(cuts, numbered: bool) -> Callable[..., Column]:
    """A function of columns: the number of a row's cell between the shared ``cuts``, or its places as bytes if the cells are too
    many to be numbered."""
    @F.arrow_udf(T.LongType() if numbered else T.BinaryType())
    def cell(*columns: pa.Array) -> pa.Array:
        values = [c.to_numpy(zero_copy_only=False) for c in columns]
        if numbered:
            return pa.array(cell_numbers(values, cuts.value, len(columns[0])))
        places = np.stack(cell_places(values, cuts.value), axis=1).astype(np.int32)
        return pa.array([p.tobytes() for p in places], pa.binary())

    return cell


def tree_contributions(model, table: DataFrame, key: str, features: list[str], output: int = 1,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep..., x, phi, base, prediction)`` for a tree ensemble; ``output`` picks the class of a forest."""
    return leaf_contributions(forest_leaves(model, output), table, key, features, keep)


def leaf_contributions(leaves: list[tuple], table: DataFrame, key: str, features: list[str], keep: tuple[str, ...] = (),
                       cells: bool | None = None) -> DataFrame:
    """``tree_contributions`` for the leaves of an ensemble.

    Rows that lie between the same cuts in every column have the same contributions. Where the cuts make few cells, or cells
    of such rows are fewer than a quarter of the rows (counted by a sketch; ``cells`` overrides it), each is explained once, and
    the rows get theirs by a join on the cell. Few cells are written and sent to the rows; more meet them by a shuffle.
    """
    base = float(sum(leaf[0] * leaf[1] for leaf in leaves))
    context = table.sparkSession.sparkContext
    shared, ends = context.broadcast(leaf_tables(leaves)), all_cuts(leaves, len(features))
    carried, names = [key, *keep], [f"_x{i}" for i in range(len(features))]
    numbers = T.ArrayType(T.DoubleType())
    phi_field = T.StructField("phi", numbers)

    def explain(batches):
        for pdf in batches:
            if len(pdf):
                tables, others = shared.value
                x = np.zeros((len(pdf), len(names)))
                for i, n in enumerate(names):
                    x[:, i] = pdf.pop(n)
                yield pdf.assign(phi=list(table_contributions(x, tables) + path_contributions(x, others)[0]))

    rows = table.select(*[_without_nan(table, c) for c in carried], *[number(c).alias(n) for c, n in zip(features, names)])
    cell = cell_column(context.broadcast(ends), cell_count(ends) < NUMBERS)(*names) if names else F.lit(0)
    placed = rows.withColumn("_cell", cell)
    few = cell_count(ends) * (len(features) + 4) <= SENT_NUMBERS
    if cells is None and not few:
        seen = placed.agg(F.approx_count_distinct("_cell").alias("cells"), F.count(F.lit(1)).alias("rows")).first()
        cells = seen["cells"] * 4 < seen["rows"]
    total = F.aggregate("phi", F.lit(base), lambda t, v: t + v).alias("prediction")
    x = F.array(*names).cast(numbers).alias("x")
    if cells or cells is None:
        distinct = placed.select("_cell", *names).dropDuplicates(["_cell"]).repartition(context.defaultParallelism, "_cell")
        one = distinct.mapInPandas(explain, T.StructType([placed.schema["_cell"], phi_field])).select("_cell", "phi", total)
        found = placed.join(F.broadcast(materialise(one, "explained-cells")) if few else one, "_cell")
        return found.select(*carried, x, "phi", F.lit(base).alias("base"), "prediction")
    shape = T.StructType([*[table.schema[c] for c in carried], T.StructField("x", numbers), phi_field])
    found = rows.select("*", x).mapInPandas(explain, shape)
    return found.select(*carried, "x", "phi", F.lit(base).alias("base"), total)


# Summaries -----------------------------------------------------------------------------------------------------

def _raw_importance(contributions: DataFrame, features: list[str]) -> DataFrame:
    """``(i, feature, raw)``: mean absolute contribution, one pass."""
    means = contributions.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f"_{i}") for i in range(len(features))])
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"), F.col(f"_{i}").alias("raw"))
                       for i, c in enumerate(features)])
    return means.select(F.explode(listed).alias("e")).select("e.*")


def global_importance(contributions: DataFrame, features: list[str]) -> DataFrame:
    """``(rank, feature, importance, importance_percentage)``: mean absolute contribution, largest first."""
    return _ranked(_raw_importance(contributions, features))


def _ranked(raw: DataFrame) -> DataFrame:
    total = F.sum("raw").over(Window.partitionBy(F.lit(0)))
    frame = (raw.withColumn("importance", F.round("raw", 4))
             .withColumn("importance_percentage", F.round(F.coalesce(
                 F.try_divide(F.col("raw"), total), F.lit(0.0)) * 100, 2)))
    # One row per feature.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "i")
    return frame.select(F.row_number().over(order).alias("rank"), "feature", "importance", "importance_percentage")


def mean_over_classes(frames: list[DataFrame], features: list[str]) -> DataFrame:
    """Importance of a multi-class model: mean over the classes."""
    parts = [_raw_importance(f, features) for f in frames]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    return _ranked(joined.groupBy("i", "feature").agg(F.avg("raw").alias("raw")))


def local_explanations(contributions: DataFrame, key: str, features: list[str], keys: list | None = None,
                       limit: int = LOCAL_ROWS) -> DataFrame:
    """Contributions of a few rows, keyed by row: ``(key, position, feature, value, shap_contribution, direction,
    prediction, baseline)``."""
    baseline = contributions.agg(F.avg("prediction")).scalar()
    rows = contributions.filter(F.col(key).isin(keys)) if keys else contributions.orderBy(key).limit(limit)
    names = F.array(*[F.lit(c) for c in features])
    ordered = F.array_sort(
        F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.struct(
            (-F.abs(F.get(F.col("phi"), i))).alias("order"), i.alias("i"), F.get(names, i).alias("feature"),
            F.get(F.col("x"), i).alias("value"), F.get(F.col("phi"), i).alias("phi"))))
    return (rows.select(key, F.round("prediction", 4).alias("prediction"), F.posexplode(ordered).alias("position", "c"))
            .select(key, (F.col("position") + 1).alias("position"), "c.feature", "c.value",
                    F.round("c.phi", 4).alias("shap_contribution"),
                    F.when(F.col("c.phi") > 0, "positive").otherwise("negative").alias("direction"),
                    "prediction", F.round(baseline, 4).alias("baseline")))


def explain_model(df: DataFrame, key: str, features: list[str], target: str, name: str = "Ridge",
                  problem: str = "regression", sample: float | None = None, seed: int = 42, **options) -> dict:
    """Refit on clean inputs and explain: frames ``contributions``, ``importance`` and ``local``.

    With more than two classes ``contributions`` and ``local`` have a row per class, named by column ``class`` (its
    place in sorted order), and importance is the mean over the classes.
    """
    if not features:
        raise ValueError("features must not be empty")
    table = clean_table(df, key, features, target, problem)
    model = fit_clean_model(table, features, name, problem, seed=seed, **options)
    chosen = table if sample is None else table.sample(fraction=sample, seed=seed)
    frames = class_contributions(model, chosen, key, features)
    if len(frames) == 1:
        found = frames[0]
        return {"model": model, "table": table, "contributions": found, "importance": global_importance(found, features),
                "local": local_explanations(found, key, features)}
    local = [local_explanations(f, key, features).withColumn("class", F.lit(i)) for i, f in enumerate(frames)]
    named = [f.withColumn("class", F.lit(i)) for i, f in enumerate(frames)]
    return {"model": model, "table": table, "contributions": reduce(DataFrame.unionByName, named),
            "importance": mean_over_classes(frames, features), "local": reduce(DataFrame.unionByName, local)}


def class_contributions(model, table: DataFrame, key: str, features: list[str]) -> list[DataFrame]:
    """One frame of contributions per class; a single one for regression and for two classes."""
    if isinstance(model, OneVsRestModel):
        return [tree_contributions(one, table, key, features) for one in model.models]
    if isinstance(model, LogisticRegressionModel) and model.numClasses > 2:
        rows, starts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        return [linear_contributions(table, key, dict(zip(features, map(float, w))), float(b))
                for w, b in zip(rows, starts)]
    if hasattr(model, "coefficients"):
        weights = dict(zip(features, [float(c) for c in model.coefficients]))
        return [linear_contributions(table, key, weights, float(model.intercept))]
    classes = getattr(model, "numClasses", 2)
    if classes > 2:
        return [tree_contributions(model, table, key, features, output=i) for i in range(classes)]
    return [tree_contributions(model, table, key, features)]


def predictions(model, table: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(table))


# Chart data ----------------------------------------------------------------------------------------------------

def importance_summary(importance: DataFrame) -> DataFrame:
    """Count, mean, median, deviation, the three leaders and their share."""
    value = F.col("importance")
    leaders = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "feature"))))
    return importance.agg(
        F.count(F.lit(1)).alias("total_features"), F.round(F.avg(value), 4).alias("mean_importance"),
        F.round(F.percentile(value, F.lit(0.5)), 4).alias("median_importance"),
        F.round(F.stddev_pop(value), 4).alias("std_importance"),
        F.array_join(F.transform(leaders, lambda s: s["feature"]), ", ").alias("top_3_features"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("rank") <= 3, value)), F.sum(value)), F.lit(0.0)) * 100, 1)
        .alias("top_3_coverage_percent"),
        F.max(F.when(F.col("rank") == 1, F.col("feature"))).alias("top_feature"))


def importance_bars(importance: DataFrame) -> DataFrame:
    return (importance.filter(F.col("rank") <= TOP_BARS)
            .select("rank", "feature", "importance_percentage", F.concat(
                F.round("importance_percentage", 1).cast("decimal(10,1)").cast("string"), F.lit("%")).alias("label")))


def waterfall(local: DataFrame, key: str) -> DataFrame:
    """Steps from baseline to prediction per explained row: label, value, measure, running total, colour."""
    steps = local.filter(F.col("position") <= TOP_STEPS)
    upto = (Window.partitionBy(key).orderBy("position")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = steps.select(
        key, "position", F.col("feature").alias("label"), F.col("shap_contribution").alias("value"),
        F.lit("relative").alias("measure"), (F.col("baseline") + F.sum("shap_contribution").over(upto)).alias("total"),
        F.when(F.col("shap_contribution") > 0, "green").otherwise("red").alias("color"))
    ends = local.filter(F.col("position") == 1)
    first = ends.select(key, F.lit(0).alias("position"), F.lit("Baseline").alias("label"), F.lit(0.0).alias("value"),
                        F.lit("total").alias("measure"), F.col("baseline").alias("total"), F.lit("blue").alias("color"))
    last = ends.select(key, F.lit(TOP_STEPS + 1).alias("position"), F.lit("Prediction").alias("label"),
                       F.lit(0.0).alias("value"), F.lit("total").alias("measure"), F.col("prediction").alias("total"),
                       F.lit("darkgreen").alias("color"))
    return first.unionByName(middle).unionByName(last)


def force_data(local: DataFrame, key: str) -> DataFrame:
    """Parallel arrays per explained row; a row has one entry per feature."""
    listed = F.array_sort(F.collect_list(F.struct("position", "feature", "value", "shap_contribution")))
    return (local.groupBy(key).agg(F.first("baseline").alias("base_value"), F.first("prediction").alias("prediction"),
                                   listed.alias("_l"))
            .select(key, "base_value", F.col("_l.shap_contribution").alias("shap_values"),
                    F.col("_l.value").alias("data"), F.col("_l.feature").alias("feature_names"), "prediction"))
