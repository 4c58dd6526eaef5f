"""Skew-safe ordered operations and exact quantiles against plain windows and numpy."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from lumenframe.operators.ordered import running_sums, split_row_number, with_neighbour
from lumenframe.operators.quantiles import quantile_map


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, with many equal order values."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id") % 7).alias("k"),
        (F.xxhash64("id") % 200).alias("t"), F.col("id"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("v")).cache()


@pytest.mark.parametrize("step", [1, -1])
def test_hot_groups_are_cut_without_changing_the_result(skewed, step):
    found = with_neighbour(skewed, ["k"], ["t", "id"], F.col("v"), "n", step, hot_rows=100)
    order = Window.partitionBy("k").orderBy("t", "id")
    plain = skewed.withColumn("n", F.lead("v").over(order) if step == 1 else F.lag("v").over(order))
    assert sorted(map(str, found.select("id", "n").collect())) == sorted(map(str, plain.select("id", "n").collect()))


def test_running_sums_and_positions(skewed):
    cut = skewed.withColumn("b", F.floor(F.col("t") / 20))
    found = running_sums(cut, ["k"], "b", ["t", "id"], {"s": F.col("t"), "c": F.lit(1)})
    order = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.select("id", F.sum("t").over(order).alias("s"), F.count(F.lit(1)).over(order).alias("c"))
    assert sorted(found.select("id", "s", "c").collect()) == sorted(plain.collect())
    numbered = split_row_number(cut, ["k"], "b", ["t", "id"], "n")
    assert sorted(numbered.select("id", "n").collect()) == sorted(plain.select("id", "c").collect())


@pytest.mark.parametrize("small", [0, 50_000])
def test_quantiles_equal_numpy(spark, small):
    values = np.concatenate([np.random.default_rng(1).normal(size=4000), np.full(2500, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "a double, b double")
    found = quantile_map(df, ["a", "b"], [0.01, 0.25, 0.5, 0.75, 0.95], small=small, accuracy=500)
    for p, q in found["a"].items():
        assert q == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert found["b"][p] == pytest.approx(np.quantile(-values, p), abs=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30))
def test_quantiles_of_few_values(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    found = quantile_map(df, ["a"], [0.25, 0.5])["a"]
    assert found[0.25] == pytest.approx(np.quantile(values, 0.25))
    assert found[0.5] == pytest.approx(np.quantile(values, 0.5))


def test_empty_and_null_columns_have_no_quantile(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert quantile_map(df, ["a", "b"], [0.5]) == {}
