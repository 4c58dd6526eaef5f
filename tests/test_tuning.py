"""Model search: sampler densities, stop rule, resuming, and fold means and winner recomputed by SQL."""

import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import models as md, tuning as tu


def test_density_is_a_mixture_of_cut_normals():
    parzen = tu.Parzen(0.0, 10.0, [2.0, 3.0, 9.0])
    assert parzen.widths == [2.5, 6.0, 6.0, 10.0]  # larger gap to the neighbours, at least span / (n + 1)

    def cut_normal(x, c, s):
        pdf = lambda v: math.exp(-((v - c) / s) ** 2 / 2)
        grid = np.linspace(0, 10, 20_001)
        return pdf(x) / np.trapezoid([pdf(v) for v in grid], grid)
    for x in (0.0, 1.7, 5.0, 9.9):
        want = sum(cut_normal(x, c, s) for c, s in zip([2, 3, 9, 5], parzen.widths)) / 4
        assert parzen.density(x) == pytest.approx(want, rel=1e-5)
    rng = random.Random(1)
    drawn = np.array([parzen.draw(rng) for _ in range(20_000)])
    assert drawn.min() >= 0 and drawn.max() <= 10
    grid = np.linspace(0, 10, 2001)
    mean = np.trapezoid([x * parzen.density(x) for x in grid], grid)
    assert drawn.mean() == pytest.approx(mean, abs=0.1)


def test_good_trials_are_the_best_tenth():
    finished = [({"model_name": "xgboost", "i": i}, v) for i, v in enumerate([.1, .9, .5, .9, .3, .2, .7, .6, .4, .8, .0])]
    good, bad = tu.split_good(finished)
    assert [p["i"] for p in good] == [1, 3] and len(bad) == 9
    assert tu.choice_weights(["a", "b"], ["a", "a"]) == {"a": 0.75, "b": 0.25}


def test_proposals_move_to_good_values():
    finished = []
    for i in range(40):
        p = tu.propose(i, 7, finished)
        assert p == tu.propose(i, 7, list(finished))
        for name, (kind, low, high) in tu.SPACE[p["model_name"]].items():
            assert low <= p[name] <= high and (kind != "int" or isinstance(p[name], int))
        depth = p.get("xgb_max_depth")
        finished.append((p, 0.5 if depth is None else 1 - abs(depth - 4) / 10))
    late = [p for p, _ in finished[20:]]
    assert sum(p["model_name"] == "xgboost" for p in late) > 10
    assert np.mean([p["xgb_max_depth"] for p in late if "xgb_max_depth" in p]) < 6
    assert {p["model_name"] for p, _ in finished[:4]} == set(tu.SPACE)


def test_median_stop():
    others = [[0.5, 0.9], [0.6, 0.1], [0.7, 0.2], [0.8, 0.3], [0.9, 0.5]]
    for own in ([0.69], [0.7], [0.71], [0.9, 0.1], [0.1, 0.9]):
        want = np.mean(own) < np.median([np.mean(o[:len(own)]) for o in others])
        assert tu.should_stop(own, others) == want
    assert not tu.should_stop([0.0], others[:4])


class Killed(Exception):
    pass


@pytest.mark.parametrize("after", [0, 1, 7, 13])
def test_a_killed_search_goes_on(spark, tmp_path, after):
    calls = []

    def evaluate(fold, models, limit=None):
        if limit is not None and len(calls) >= limit:
            raise Killed
        calls.append((fold, [m for m, _ in models]))
        return {m: (100 * random.Random(json.dumps([p, fold])).random() + (p["model_name"] == "xgboost") * 50, 150.0)
                for m, p in models}

    whole = tu.run_trials(tu.TrialStore(spark, f"{tmp_path}/whole"), 3, evaluate, trials=20, batch_size=4)
    all_calls = list(calls)
    calls.clear()
    store = tu.TrialStore(spark, f"{tmp_path}/cut")
    with pytest.raises(Killed):
        tu.run_trials(store, 3, lambda f, m: evaluate(f, m, after), trials=20, batch_size=4)
    # a folder that was begun but not marked whole is made again
    (tmp_path / "cut" / "batch=0099" / "fold=000").mkdir(parents=True)
    done = tu.run_trials(store, 3, evaluate, trials=20, batch_size=4)
    assert done == whole and calls == all_calls
    assert any(t.stopped for t in done) and not all(t.stopped for t in done)
    with pytest.raises(ValueError):
        tu.run_trials(store, 3, evaluate, trials=20, batch_size=4, seed=1)


def test_search_store_by_sql(spark, tmp_path):
    """Thirty trials of five folds over the labelled documents; fold means and winner come from the stored trials alone."""
    from lumenframe.plans.inputs import view
    df = view(spark, "/root/testdata/sf0.001", "classification")
    found = md.search(df, "doc_id", ["n_chars", "lang", "source"], "quality", max_trees=8, store=f"{tmp_path}/trials")
    got = {r["trial"]: r for r in found.trials.collect()}
    assert len(got) == 30 and {r["model_name"] for r in got.values()} == set(md.MODELS)
    rows = duckdb.sql(f"""SELECT trial, avg(hits / rows) AS score, count(*) AS folds, bool_or(stopped) AS stopped,
      sum(rows) AS rows FROM read_parquet('{tmp_path}/trials/batch=*/fold=*/*.parquet') GROUP BY trial""").fetchall()
    assert len(rows) == 30
    for trial, score, folds, stopped, n in rows:
        assert (got[trial]["folds"], got[trial]["stopped"]) == (folds, stopped)
        assert got[trial]["score"] == pytest.approx(score)
        assert stopped or (folds == 5 and n == df.count())
    winner = max((r for r in rows if not r[3]), key=lambda r: (r[1], -r[0]))
    assert found.best_params == json.loads(json.dumps(found.best_params)) and found.best_score == pytest.approx(winner[1])
    assert got[winner[0]]["model_name"] == found.best_params["model_name"]
    assert found.store.table().count() == sum(r[2] for r in rows)
    assert found.model.transform(md.with_label(df, "quality")[0]).count() == df.count()


def test_folds_are_prepared_without_their_held_rows(spark):
    """A value that only held rows have sets no column; held rows get the medians of the others."""
    rows = [(i, float(i), "a" if i % 3 else "only" if i == 0 else "b", i % 2) for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "x", "t", "y"]))
    table, classes = md.with_label(df, "y")
    table = md.stratified_folds(table, "id", "label", 3)
    ready = md.PreparedFolds(table, ["x", "t"], len(classes), 3)
    fold = table.filter("id = 0").first()["fold"]
    sizes = {r["split"]: r["d"] for r in ready.rows.selectExpr("split", "size(f) AS d").distinct().collect()}
    assert sizes[fold] == 3 and all(d == 4 for f, d in sizes.items() if f != fold)
    for params in ({"model_name": "logistic_regression", "lr_c": 1.0},
                   {"model_name": "xgboost", "xgb_n_estimators": 5, "xgb_max_depth": 3, "xgb_learning_rate": 0.3}):
        hits, n = ready.evaluate(fold, [(7, params)])[7]
        assert n == 20 and 0 <= hits <= 20


def test_folds_run_together(spark, tmp_path):
    """All folds of trials that nothing can stop are asked for at once, and of later ones all but the first; what comes out
    is that of one fold after the other, also in the store and when a search goes on."""
    asked = []

    def evaluate(fold, models):
        return {m: (100 * random.Random(json.dumps([p, fold])).random(), 150.0) for m, p in models}

    def together(folds, models):
        asked.append((folds, [m for m, _ in models]))
        return {f: evaluate(f, models) for f in folds}

    kept = [tu.TrialStore(spark, f"{tmp_path}/{x}") for x in ("one", "many")]
    want = tu.run_trials(kept[0], 3, evaluate, trials=18, batch_size=6)
    assert tu.run_trials(kept[1], 3, None, trials=18, batch_size=6, together=together) == want
    assert any(t.stopped for t in want)
    assert [f for f, _ in asked] == [[0, 1, 2], [0], [1, 2], [0], [1, 2]]
    assert asked[2][1] == [t.number for t in want[6:12] if not (t.stopped and len(t.scores) == 1)]
    one, many = (sorted(map(tuple, k.table().collect())) for k in kept)
    assert one == many
    asked.clear()
    part = tu.TrialStore(spark, f"{tmp_path}/part")
    tu.run_trials(part, 3, evaluate, trials=6, batch_size=6)
    assert tu.run_trials(part, 3, None, trials=18, batch_size=6, together=together) == want and len(asked) == 4


def test_folds_of_a_table_side_by_side(spark):
    rows = [(i, float(i % 17), "ab"[i % 2], int(i * 7 % 17 > 8)) for i in range(90)]
    table, classes = md.with_label(spark.createDataFrame(pd.DataFrame(rows, columns=["id", "x", "t", "y"])), "y")
    ready = md.PreparedFolds(md.stratified_folds(table, "id", "label", 3), ["x", "t"], len(classes), 3)
    models = [(0, {"model_name": "logistic_regression", "lr_c": 1.0}),
              (1, {"model_name": "random_forest", "rf_n_estimators": 60, "rf_max_depth": 4}),
              (2, {"model_name": "lightgbm", "lgbm_n_estimators": 5, "lgbm_learning_rate": 0.3})]
    assert ready.evaluate_folds([0, 1, 2], models) == {f: ready.evaluate(f, models) for f in range(3)}
