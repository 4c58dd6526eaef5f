"""Binned trees: histograms and gains beside SQL, both boosters, many executors beside one task, forests."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import boosting as bo, models as md


def made(n=600, classes=2, seed=3):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n), rng.integers(0, 2, n)].astype(float)
    z = 1.5 * x[:, 0] - (x[:, 1] == 2) * 2 + np.sin(3 * x[:, 2]) + rng.normal(0, 0.4, n)
    y = np.digitize(z, np.quantile(z, np.arange(1, classes) / classes)).astype(float)
    return x, y


def cells_of(x, y, classes=2):
    edges = [np.unique(np.quantile(c, np.arange(1, 20) / 20, method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    bins = bo.to_bins(x, edges)
    return bo.Cells(bins, y, np.ones(len(y)), [len(e) + 1 for e in edges])


PARAMS = {"lightgbm": {"model_name": "lightgbm", "lgbm_learning_rate": 0.1, "lgbm_n_estimators": 12},
          "xgboost": {"model_name": "xgboost", "xgb_n_estimators": 12, "xgb_max_depth": 4, "xgb_learning_rate": 0.2},
          "random_forest": {"model_name": "random_forest", "rf_n_estimators": 60, "rf_max_depth": 9}}


@pytest.mark.parametrize("penalty,least_rows,least_hess", [(0.0, 20, 1e-3), (1.0, 0, 1.0)])
def test_split_equals_sql(penalty, least_rows, least_hess):
    x, y = made()
    own = cells_of(x, y)
    g, h = bo.derivatives(np.zeros((len(y), 1)), own.label, 0, 2, True)
    histogram = own.histogram(np.arange(len(y)), np.stack([g, h, np.ones(len(y))], axis=1))
    frame = pd.DataFrame({**{f"c{j}": own.bins[:, j] for j in range(4)}, "y": y})  # noqa: F841
    rows = duckdb.sql(f"""
      WITH d AS (SELECT *, 0.5::DOUBLE - y AS g, 0.25::DOUBLE AS h FROM frame),
      u AS ({' UNION ALL '.join(f'SELECT {j} AS c, c{j}::INT AS b, g, h FROM d' for j in range(4))}),
      s AS (SELECT c, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM u GROUP BY c, b),
      l AS (SELECT c, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY c) AS gt,
        sum(h) OVER (PARTITION BY c) AS ht, sum(n) OVER (PARTITION BY c) AS nt, max(b) OVER (PARTITION BY c) AS last FROM s
        WINDOW w AS (PARTITION BY c ORDER BY b))
      SELECT s.c, s.b, s.g, s.h, s.n, CASE WHEN s.b < last AND least(nl, nt - nl) >= {least_rows}
        AND least(hl, ht - hl) >= {least_hess} THEN gl * gl / (hl + {penalty}) + (gt - gl) ** 2 / (ht - hl + {penalty})
        - gt * gt / (ht + {penalty}) END AS gain FROM s JOIN l USING (c, b) ORDER BY s.c, s.b""").fetchall()
    for c, b, sg, sh, n, _ in rows:
        np.testing.assert_allclose(histogram[:, own.offsets[c] + b], [sg, sh, n], atol=1e-9)
    best = max((r for r in rows if r[5] is not None), key=lambda r: (round(r[5], 9), -r[0], -r[1]))
    value, column, cut = bo.best_split(histogram, own.offsets, penalty, least_rows, least_hess)
    assert (column, cut) == best[:2] and value == pytest.approx(best[5])


def test_boosters_differ_in_shape():
    x, y = made(2000)
    own = cells_of(x, y)
    shapes = {}
    for name in ("lightgbm", "xgboost"):
        rounds, start, margin = bo.boost(own, 2, PARAMS[name], own.bins)
        assert len(rounds) == 12
        assert ((margin[:, 0] > 0) == y).mean() > 0.85
        for (tree,) in rounds:
            leaf = bo.leaves_of(tree, own.bins)
            counts = np.bincount(leaf)[np.unique(leaf)]
            if name == "lightgbm":
                assert len(counts) <= 31 and counts.min() >= 20
            else:
                depth = {0: 0}
                for i in np.flatnonzero(tree["column"] >= 0):
                    depth[tree["left"][i]] = depth[tree["right"][i]] = depth[i] + 1
                assert max(depth.values()) <= 4
        shapes[name] = [t["value"] for (t,) in rounds]
        np.testing.assert_allclose(margin, bo.advanced(np.tile(start, (len(y), 1)), own.bins, rounds), atol=1e-9)
    assert any(len(a) != len(b) for a, b in zip(*shapes.values()))


def test_leaf_values_are_newton_steps():
    x, y = made(500)
    own = cells_of(x, y)
    rounds, start, _ = bo.boost(own, 2, {**PARAMS["xgboost"], "xgb_n_estimators": 1})
    tree = rounds[0][0]
    leaf = bo.leaves_of(tree, own.bins)
    p = 1 / (1 + np.exp(-start[0]))
    for i in np.unique(leaf):
        here = leaf == i
        assert tree["value"][i] == pytest.approx(-0.2 * (p - y[here]).sum() / (here.sum() * p * (1 - p) + 1.0))


@pytest.mark.parametrize("name", ["lightgbm", "xgboost"])
@pytest.mark.parametrize("classes", [2, 3])
def test_executors_grow_the_same_trees(spark, monkeypatch, name, classes):
    monkeypatch.setattr(bo, "REFRESH", 2)
    x, y = made(300, classes)
    own = cells_of(x, y)
    params = {**PARAMS[name], "lgbm_n_estimators": 3, "xgb_n_estimators": 3}
    rows = spark.createDataFrame([(float(c), bytearray(b.tobytes()), 1) for c, b in zip(own.label, own.bins)],
                                 "label double, bins binary, n long").repartition(5)
    rounds, start = bo.SparkCells(rows, own.widths, classes).boost(params)
    want, begin, _ = bo.boost(own, classes, params)
    np.testing.assert_allclose(start, begin)
    assert len(rounds) == len(want) == 3
    for a, b in zip([t for r in rounds for t in r], [t for r in want for t in r]):
        for part in ("column", "bin", "left", "right"):
            assert (a[part] == b[part]).all()
        np.testing.assert_allclose(a["value"], b["value"], atol=1e-9)


def vectors(spark, x, y):
    from pyspark.ml.feature import VectorAssembler
    names = [f"x{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=[*names, "label"]))
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


@pytest.mark.parametrize("name", list(PARAMS))
@pytest.mark.parametrize("classes", [2, 3])
def test_models_predict(spark, name, classes):
    df = vectors(spark, *made(800, classes))
    model = bo.BinnedTrees(PARAMS[name], classes).fit(df)
    again = bo.BinnedTrees(PARAMS[name], classes).fit(df)
    got = model.transform(df)
    assert got.filter("label = prediction").count() > 0.8 * 800
    assert bo.dump_trees(model.rounds) == bo.dump_trees(again.rounds)


def test_beyond_a_task(spark):
    df = vectors(spark, *made(200))
    small = bo.BinnedTrees({**PARAMS["xgboost"], "xgb_n_estimators": 2}, cell_bytes=10).fit(df)
    usual = bo.BinnedTrees({**PARAMS["xgboost"], "xgb_n_estimators": 2}).fit(df)
    for a, b in zip(small.rounds, usual.rounds):
        assert (a[0]["column"] == b[0]["column"]).all()
    forest = bo.BinnedTrees({**PARAMS["random_forest"], "rf_n_estimators": 3}, cell_bytes=10).fit(df)
    assert forest.transform(df).filter("label = prediction").count() > 150


def test_edges_cut_at_values(spark):
    df = spark.createDataFrame([([float(i % 7), 1.0, float(i)],) for i in range(1000)], "f array<double>")
    edges = bo.bin_edges(df)[()]
    assert list(edges[0]) == [0, 1, 2, 3, 4, 5] and len(edges[1]) == 0 and 200 <= len(edges[2]) <= 254
    assert (bo.to_bins(np.array([[-1.0, 1, 0], [0, 1, 0], [6, 1, 0], [9, 1, 0]]), edges)[:, 0] == [0, 0, 6, 6]).all()


def test_cells_join_equal_rows(spark):
    rows = spark.createDataFrame([(0, False, 1.0, [1.0, 2.0])] * 5 + [(0, True, 1.0, [1.0, 2.0]), (0, False, 0.0, [1.0, 3.0])],
                                 "split int, held boolean, label double, f array<double>")
    edges = bo.bin_edges(rows.filter("not held"), ["split"])
    got = bo.cells(rows, ["split", "held"], edges).collect()
    assert sorted((r["held"], r["label"], r["n"]) for r in got) == [(False, 0.0, 1), (False, 1.0, 5), (True, 1.0, 1)]


def test_one_class_and_no_columns(spark):
    df = vectors(spark, np.ones((30, 2)), np.zeros(30))
    for params in PARAMS.values():
        assert bo.BinnedTrees(params).fit(df).transform(df).agg(F.sum("prediction")).first()[0] == 0


def test_explained_names_still_map():
    assert type(md.build_explained_model("ExtraTreesClassifier", "classification", 10)).__name__ == "ExtraTrees"


def test_trees_travel_as_few_bytes(spark):
    """A forest of deep trees reaches the driver packed and is unpacked tree by tree."""
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 200, (3_000, 3)).astype(np.uint8)
    own = bo.Cells(bins, rng.integers(0, 2, 3_000), np.ones(3_000), [200] * 3)
    rounds, _, _ = bo.fit_cells(own, own, {"model_name": "random_forest", "rf_n_estimators": 4, "rf_max_depth": 30}, 2, 1)
    data = [bo.dump_trees(t) for t in rounds]
    nodes = sum(len(t["column"]) for trees in rounds for t in trees)
    assert sum(map(len, data)) < 16 * nodes
    stored = bo.StoredTrees(data)
    assert len(stored) == 4
    for (a,), (b,) in zip(rounds, stored):
        assert set(a) == set(b) and all(np.array_equal(a[k], b[k]) for k in a)
        assert np.array_equal(bo.leaves_of(a, bins), bo.leaves_of(b, bins))


@pytest.mark.parametrize("classes", [2, 3])
def test_levels_give_the_tree_of_the_queue(classes):
    x, y = made(1500, classes)
    own, p = cells_of(x, y, classes), bo.boosting_params({**PARAMS["xgboost"], "xgb_max_depth": 7})
    g, h = bo.derivatives(np.tile(bo.start_margins(np.bincount(own.label)), (len(y), 1)), own.label, 0, classes, False)
    stats = np.stack([g, h, np.ones(len(y))], axis=1)
    want, ends = bo.grow(lambda nodes: {i: own.histogram(np.flatnonzero(bo.goes(path, own.bins)), stats)
                                        for i, path in nodes.items()}, own.offsets, p, eager=False)
    got, leaf = bo.grow_levels(own, np.concatenate([own.bins, own.bins[::-1]]), stats, p)
    assert set(got) == set(want) and all(np.array_equal(got[k], want[k]) for k in want) and len(got["column"]) > 40
    assert np.array_equal(leaf, np.r_[(there := bo.leaves_of(want, own.bins)), there[::-1]])
    assert all((there[bo.goes(path, own.bins)] == node).all() for path, node in ends.items())


def test_gini_cuts_of_many_nodes():
    """Against each cut of each node on its own; nodes whose columns don't vary take a cut of any column."""
    rng = np.random.default_rng(8)
    bins = np.c_[rng.integers(0, 30, 900), rng.integers(0, 2, (900, 3)), np.zeros(900)].astype(np.uint8)
    label, weight, at = rng.integers(0, 3, 900), rng.integers(1, 4, 900).astype(float), rng.integers(0, 40, 900)
    at[:900] = np.r_[np.arange(40), at[40:]]
    whole = np.stack([np.bincount(label[at == i], weights=weight[at == i], minlength=3) for i in range(40)])
    columns = np.sort(np.argsort(rng.random((40, 5)), axis=1)[:, :2], axis=1)
    columns[7] = 3, 4
    bins[at == 7, 3] = 1
    column, cut, left = bo.gini_cuts(bins, label, weight, at, whole, columns, [30, 2, 2, 2, 1])
    for i in range(40):
        best = None
        for c in columns[i]:
            for b in range(30):
                low = (at == i) & (bins[:, c] <= b)
                ours = np.bincount(label[low], weights=weight[low], minlength=3)
                rest = whole[i] - ours
                if ours.sum() and rest.sum():
                    score = (ours ** 2).sum() / ours.sum() + (rest ** 2).sum() / rest.sum()
                    if best is None or score > best[0]:
                        best = score, c, b, ours
        assert (column[i] == -1) == (best is None)
        if best:
            assert (column[i], cut[i]) == best[1:3] and np.array_equal(left[i], best[3])
    assert column[7] == -1
    picked, place = bo.random_cuts(bins, np.arange(900), at, np.array([7, 9]), 40, np.random.default_rng(2))
    for i, c, b in zip((7, 9), picked, place):
        low = bins[at == i, c] <= b
        assert low.any() and not low.all()


def test_every_block_has_a_task_of_its_own(spark):
    """Two blocks in one task would run one after the other while other tasks are empty."""
    packed = spark.createDataFrame([(s, b"x") for s in range(5)], "split int, bins binary")
    asked = [(m, s, p) for m, p in enumerate([*PARAMS.values(), {**PARAMS["random_forest"], "rf_n_estimators": 120}])
             for s in range(5)]
    rows = bo.dealt_parts(packed, "split", asked).select(F.spark_partition_id().alias("at"), "task", "model", "split").collect()
    assert sorted(r["at"] for r in rows) == sorted(r["task"] for r in rows) == list(range(5 * (1 + 1 + 2 + 3)))
    assert {(r["model"], r["split"]) for r in rows} == {(m, s) for m, s, _ in asked}
