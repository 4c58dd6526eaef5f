"""Anomaly scores: injected outliers and brute force."""

import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import anomaly as an
from lumenframe.operators.neighbours import neighbour_scores


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, k - 1]


@pytest.mark.parametrize("k,cell_rows", [(1, 50), (5, 50), (5, 10_000)])
def test_neighbours_equal_brute_force(spark, k, cell_rows):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(400, 3)), np.tile([[0.5, 0.5, 0.5]], (200, 1)), np.tile([[9.0, 9.0, 9.0]], (3, 1)),
                   rng.normal(5, 0.1, size=(100, 3))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    found = neighbour_scores(df, "id", ["a", "b", "c"], k, cell_rows).orderBy("id").toPandas()
    assert len(found) == len(x)
    np.testing.assert_allclose(found["neighbour_score"], brute(x, k), atol=1e-6)


def test_injected_anomalies_are_found(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"id": range(300), "montant": rng.normal(100, 20, 300), "duree": rng.normal(30, 5, 300),
                        "nb": rng.integers(1, 10, 300), "ville": rng.choice(["Paris", "Lyon", "Nice"], 300)})
    pdf.loc[:9, "montant"] = rng.uniform(5000, 9000, 10)
    pdf.loc[:9, "duree"] = rng.uniform(300, 500, 10)
    df = spark.createDataFrame(pdf)
    scored = an.anomaly_scores(df, "id", contamination=0.05)
    flagged = {r["id"] for r in scored.filter("label = 1").collect()}
    assert len(flagged & set(range(10))) >= 8
    totals = an.anomaly_totals(scored).first()
    assert 2.0 <= totals["anomaly_rate"] <= 5.5
    top = an.top_anomalies(scored, "id", 5)
    features = an.feature_columns(df, "id")
    drivers = an.driving_features(an.encoded_matrix(df, "id"), "id", features, top).collect()
    assert {r["feature"] for r in drivers} >= {"montant", "duree"}


def test_isolation_prefers_outliers_and_is_repeatable(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(500, 2)), [[12.0, 12.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(501), "a": x[:, 0], "b": x[:, 1]}))
    first = an.isolation_scores(df, "id", ["a", "b"], trees=30).toPandas().set_index("id")["isolation_score"]
    again = an.isolation_scores(df.repartition(7), "id", ["a", "b"], trees=30).toPandas().set_index("id")["isolation_score"]
    assert first.idxmax() == 500
    pd.testing.assert_series_equal(first.sort_index(), again.sort_index())


def test_codes_follow_text_order_and_mark_unknown_values(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("a",)], "t string")
    codes = an.ordinal_codes(df, ["t"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0.0, "b": 1.0, "é": 2.0}
    other = spark.createDataFrame([("a",), ("zz",), (None,)], "t string")
    assert sorted(str(r["t"]) for r in an.encode(other, ["t"], codes).collect()) == ["-1.0", "0.0", "None"]


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        an.anomaly_scores(spark.range(5).selectExpr("id", "id AS a"), "id")


def test_severity_bounds(spark):
    df = spark.createDataFrame([(0.7,), (0.4,), (0.39,)], "s double")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(an.severity(F.col("s"))).collect()] == ["high", "medium", "low"]


def test_distances_of_a_task_are_bounded():
    """A box of many points holds few distances at once, and boxes of few columns are small."""
    import tracemalloc
    from lumenframe.operators import neighbours as nb
    x = np.random.default_rng(3).normal(size=(6_000, 3))
    copies = np.ones(len(x), dtype=np.int64)
    tracemalloc.start()
    found = nb.smallest(x, x, copies, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    want = np.sort(np.sqrt(((x[:50, None, :] - x[None]) ** 2).sum(axis=2)), axis=1)[:, :4]
    np.testing.assert_allclose(found[:50], want, atol=1e-12)
    assert nb.box_rows(4) == 500 < nb.box_rows(6) < nb.box_rows(12) == nb.CELL_ROWS
