"""Approximate neighbour scores: recall in many columns, copies, repeatability."""

import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import anomaly as an, near_trees as nt
from lumenframe.plans import anomalies as plans


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, k - 1]


def frame(spark, x):
    names = [f"c{j}" for j in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), **dict(zip(names, x.T))})), names


def test_recall_in_twelve_columns(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(3000, 12)), rng.normal(4, 0.3, size=(900, 12)), np.tile(rng.normal(size=12), (100, 1))])
    df, names = frame(spark, x)
    got = nt.approximate_scores(df, "id", names, 5).orderBy("id").toPandas()["neighbour_score"].to_numpy()
    want = brute(x, 5)
    assert (got >= want - 1e-6).all()
    assert (got <= want + 1e-6).mean() >= 0.9
    assert (got[-100:] < 1e-6).all()  # copies are each other's neighbours


def test_large_groups_are_cut_and_runs_agree(spark, monkeypatch):
    monkeypatch.setattr(nt, "GROUP_ROWS", 150)
    monkeypatch.setattr(nt, "SAMPLE", 200)
    x = np.random.default_rng(8).normal(size=(1500, 6))
    df, names = frame(spark, x)
    one, two = (nt.approximate_scores(d, "id", names, 3, leaf_rows=64).orderBy("id").toPandas() for d in (df, df.repartition(5)))
    assert len(one) == 1500 and (one["neighbour_score"] >= brute(x, 3) - 1e-6).all()
    assert len(two) == 1500 and np.isfinite(one["neighbour_score"]).all()


def test_few_rows_and_modes(spark):
    df, names = frame(spark, np.array([[0.0, 0], [0, 0], [3, 4]]))
    assert [r["neighbour_score"] for r in nt.approximate_scores(df, "id", names, 2).orderBy("id").collect()] == [5, 5, 5]
    assert nt.approximate_scores(df.limit(1), "id", names, 2).first()["neighbour_score"] == 0
    with pytest.raises(ValueError):
        an.anomaly_scores(df, "id", neighbours="other")


def test_ensemble_takes_the_approximate_mode(spark):
    x = np.vstack([np.random.default_rng(1).normal(size=(300, 4)), np.full((3, 4), 15.0) + np.arange(3)[:, None]])
    df, _ = frame(spark, x)
    scored = an.anomaly_scores(df, "id", neighbours="approximate")
    assert {r["id"] for r in an.top_anomalies(scored, "id", 3).collect()} == {300, 301, 302}


def test_recall_of_the_query(spark):
    assert plans.c06_approximate_recall(spark, "/root/testdata/sf0.001").first()["recall"] >= 0.9
