"""Profile of small frames, edge frames included."""

import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import profile as pr


@pytest.fixture(scope="module")
def listings(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"prix": rng.integers(100, 900, 200).astype(float), "surface": rng.normal(80, 20, 200),
                        "ville": rng.choice(["Paris", "Lyon", "Nice"], 200), "annee": rng.integers(1950, 2020, 200)})
    pdf.loc[rng.choice(200, 10), "surface"] = np.nan
    pdf["double_prix"] = pdf["prix"] * 2
    return pdf, spark.createDataFrame(pdf)


def test_numeric_profile_equals_pandas(listings):
    pdf, df = listings
    rows = {r["column"]: r for r in pr.numeric_profile(df).collect()}
    for c in ("prix", "surface", "annee"):
        s = pdf[c].dropna()
        assert rows[c]["mean"] == pytest.approx(s.mean(), abs=1e-4)
        assert rows[c]["median"] == pytest.approx(s.median(), abs=1e-4)
        assert rows[c]["std"] == pytest.approx(s.std(), abs=1e-4)
        assert rows[c]["skewness"] == pytest.approx(s.skew(), abs=1e-4)
        assert rows[c]["q3"] == pytest.approx(s.quantile(0.75), abs=1e-4)
        assert rows[c]["missing_count"] == int(pdf[c].isna().sum())


def test_correlations_equal_pandas(listings):
    pdf, df = listings
    want = pdf[["prix", "surface", "annee", "double_prix"]].corr()
    for r in pr.correlations(df).collect():
        assert r["correlation"] == pytest.approx(want.loc[r["column_a"], r["column_b"]], abs=1e-4)
    pair = pr.strong_pairs(pr.correlations(df)).first()
    assert (pair["column_a"], pair["column_b"], pair["strength"]) == ("prix", "double_prix", "very strong")


def test_column_types(spark):
    df = spark.createDataFrame([("Appartement", "Paris", 1, 2.5, "2024-01-02"), ("Maison", "Lyon", 2, None, "2024-05-06"),
                                ("Studio", None, 3, 1.0, None)],
                               "nom string, ville string, prix int, surface double, date string")
    kinds = {r["column"]: r["semantic_type"] for r in pr.column_types(df).collect()}
    assert kinds == {"nom": "categorical", "ville": "categorical", "prix": "numeric", "surface": "numeric",
                     "date": "datetime"}


def test_many_distinct_texts_are_text(spark):
    df = spark.range(100).selectExpr("concat('word ', id) AS t", "concat('c', id % 10) AS c")
    kinds = {r["column"]: r["semantic_type"] for r in pr.column_types(df).collect()}
    assert kinds == {"t": "text", "c": "categorical"}


@pytest.mark.parametrize("rows", [[], [(1.0, None, 5.0, "x")], [(1.0, None, 5.0, "x")] * 3,
                                  [(float("nan"), None, 5.0, None), (2.0, None, 5.0, "é😀"), (None, None, 5.0, "  ")]])
def test_edge_frames(spark, rows):
    df = spark.createDataFrame(rows, "a double, empty double, flat double, t string")
    parts = pr.profile_table(df)
    assert parts["missing"].count() == 4
    assert "empty" not in [r["column"] for r in parts["numeric"].collect()]
    assert parts["insights"].count() >= 2
    if rows:
        flat = parts["numeric"].filter("column = 'flat'").first()
        assert flat["outlier_count"] == 0 and flat["iqr"] == 0.0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 0.1 + 0.2) for i in range(50)], "a double, flat double")
    found = {(r["column_a"], r["column_b"]): r["correlation"] for r in pr.correlations(df).collect()}
    assert found[("a", "a")] == 1.0 and found[("a", "flat")] is None and found[("flat", "flat")] is None


def test_target_by_name_then_by_values(spark):
    df = spark.createDataFrame([(1, "yes", "a", 0), (2, "no", "b", 1), (3, "yes", "a", 1)],
                               "id int, flag string, churn_kind string, bit int")
    assert pr.detect_target(df).first()["column"] == "churn_kind"
    assert pr.detect_target(df.drop("churn_kind")).first()["column"] == "flag"
    assert pr.detect_target(df.select("id")).count() == 0
