"""Dates in mixed forms, beside a parser that reads each value on its own with the month first."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import dates, profile as pr

VALUES = ["2024-01-05", "2024-1-5", "2024/01/05", "01/05/2024", "13/05/2024", "31/12/2024", "12/31/2024", "32/01/2024", "13/13/2024",
          "1/5/24", "05.01.2024", "13.01.2024", "5 January 2024", "January 5, 2024", "Jan 5 2024", "5 Jan 2024", "05-Jan-2024",
          "Jan 2024", "2024 Jan", "2024-01", "2024", "20240105", "202401", "5", "12", "240105", "2024-01-05 10:20",
          "2024-01-05 10:20:30", "2024-01-05T10:20:30Z", "2024-01-05T10:20:30+02:00", "2024-01-05 10:20:30.123", "10:20", "10:20:30",
          "2024-02-30", "02/30/2024", "Mon", "abc", "A", "N", "1.5", "1-2", "2024-13-01", "2024-31-12", "janvier 5 2024",
          "5 janv 2024", "  2024-01-05  ", "1/2", "12h", "0", "-1", "1e5", "2024-01-05 25:00", "Fri Jan 5 2024", "5th January 2024",
          "01-05-2024", "13-05-2024", "05/2024", "R", "x1", "a1", "29 Feb 2023", "29 Feb 2024", "02/29/23", "2024-06-31",
          "3 March 2021 11:05 PM", "3 March 2021 13:05", "7.7", "12.5", "1234567", "id-7", "2024-01-05T10:20", "31 Apr 2024"]


def parsed(value):
    try:
        found = pd.to_datetime(pd.Series([value]), format="mixed", dayfirst=False)[0]
    except Exception:
        return None
    return None if found is pd.NaT else found


def read(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {r["value"]: r["d"] for r in df.select("value", dates.read_date(F.col("value")).alias("d")).collect()}


def test_values_are_read_as_the_parser_does(spark):
    got = read(spark, VALUES)
    for v in VALUES:
        want = parsed(v)
        assert (got[v]["form"] is not None) == (want is not None), (v, got[v], want)
        if want is not None and got[v]["form"] != "time":
            assert got[v]["date"] == want.date(), v
    assert got["2024-01-05T10:20:30Z"]["zoned"] and not got["2024-01-05 10:20"]["zoned"]
    assert got["13/05/2024"]["form"] == "day_first" and got["01/05/2024"]["form"] == "month_first"


def test_random_forms(spark):
    rng = random.Random(5)
    forms = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%d %B %Y", "%b %d, %Y", "%Y%m%d", "%Y/%m/%d %H:%M", "%d-%b-%Y",
             "%Y-%m-%dT%H:%M:%SZ", "%A, %d %B %Y"]
    values = [(pd.Timestamp(rng.randint(0, 2_000_000_000), unit="s")).strftime(rng.choice(forms)) for _ in range(400)]
    got = read(spark, set(values))
    for v in values:
        assert got[v]["date"] == parsed(v).date(), v


@pytest.mark.parametrize("values,kind", [
    (["2024-01-05", "13/05/2024", "Jan 5 2024", "2024-01-05T10:00:00Z", "2024-01-05T10:00:00+02:00"], "datetime"),
    (["2024-01-05", "", None, " "], "datetime"), (["2024-01-05", "not a date"], "categorical"), (["", "", None], "categorical"),
    ([None, None], "categorical"), (["31/02/2024", "2024-01-05"], "categorical"), ([f"{i}/13/2024" for i in range(1, 13)], "datetime"),
    ([f"13/{i}/2024" for i in range(1, 14)], "categorical"), ([f"word {i}" for i in range(30)], "text"),
    (["1", "2", "3"], "categorical")])
def test_columns_are_dates_as_a_whole(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert pr.column_types(df).first()["semantic_type"] == kind


def test_given_formats_alone(spark):
    df = spark.createDataFrame([("05/01/2024",), ("13/05/2024",)], "t string")
    assert pr.column_types(df, ["dd/MM/yyyy"]).first()["semantic_type"] == "datetime"
    assert pr.column_types(df, ["MM/dd/yyyy"]).first()["semantic_type"] == "categorical"


def test_forms_are_counted_once_per_value(spark):
    df = spark.createDataFrame([("01/02/2024", ""), ("01/02/2024", "x"), ("25/12/2023", "2024-01-01")], "a string, b string")
    got = {(r["column"], r["form"]): (r["distinct_values"], r["rows"]) for r in dates.date_forms(pr.value_counts(df, ["a", "b"])).collect()}
    assert got == {("a", "month_first"): (1, 2), ("a", "day_first"): (1, 1), ("b", "blank"): (1, 1), ("b", "other"): (1, 1),
                   ("b", "year_first"): (1, 1)}
