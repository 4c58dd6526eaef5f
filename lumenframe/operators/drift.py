"""Drift between a baseline and a current table: two-sample Kolmogorov-Smirnov per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.operators.ordered import running_sums
from lumenframe.operators.profile import numeric_columns
from lumenframe.operators.quantiles import long_values
from lumenframe.session import materialise

ALPHA = 0.05
EDGES = 64
SERIES_TERMS = 100


def baseline_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, rows, mean, std)`` per numeric column; ``std`` is the population deviation."""
    columns = numeric_columns(df) if columns is None else columns
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("rows"),
                             F.avg(F.col(c).cast("double")).alias("mean"),
                             F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(f"_{i}")
                    for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("e")).select("e.*")


def baseline_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, copies)``: the whole distribution, exact and mergeable, instead of a sample."""
    columns = numeric_columns(df) if columns is None else columns
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("copies"))


def ks_distances(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``(column, n, m, ks_stat)`` from two value tables.

    Both distribution functions are running sums over sampled value ranges, so one column is spread over many tasks.
    """
    both = materialise(baseline.select("column", "value", F.col("copies").alias("b"), F.lit(0).cast("long").alias("c"))
            .unionByName(current.select("column", "value", F.lit(0).cast("long").alias("b"),
                                        F.col("copies").alias("c")))
            .groupBy("column", "value").agg(F.sum("b").alias("b"), F.sum("c").alias("c")), "distributions")
    marks = [i / EDGES for i in range(1, EDGES)]
    edges = both.groupBy("column").agg(F.array_distinct(F.percentile_approx("value", marks, 1000)).alias("edges"))
    sizes = both.groupBy("column").agg(F.sum("b").alias("n"), F.sum("c").alias("m"))
    cut = (both.join(F.broadcast(edges), "column")
           .withColumn("bucket", F.size(F.filter("edges", lambda e: e <= F.col("value")))).drop("edges"))
    summed = running_sums(cut, ["column"], "bucket", ["value"], {"fb": F.col("b"), "fc": F.col("c")})
    gap = F.abs(F.try_divide(F.col("fb"), F.col("n")) - F.try_divide(F.col("fc"), F.col("m")))
    return (summed.join(F.broadcast(sizes), "column").groupBy("column")
            .agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max(gap).alias("ks_stat")))


def asymptotic_p(ks_stat: Column, n: Column, m: Column) -> Column:
    """Two-sided p-value from the limiting distribution, effective size ``n m / (n + m)``.

    For small arguments the alternating series converges slowly, so its theta-function form takes over.
    """
    z = F.sqrt(n * m / (n + m)) * ks_stat
    steps = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    tail = F.aggregate(steps, F.lit(0.0), lambda t, k: t + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * z * z))
    body = F.aggregate(steps, F.lit(0.0), lambda t, k: t + F.exp(
        -F.pow(2.0 * k - 1, F.lit(2.0)) * (3.141592653589793 ** 2) / (8.0 * z * z)))
    small = 1 - F.sqrt(F.lit(2 * 3.141592653589793)) / z * body
    return F.when(z <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(z < 1, small)
                                                                         .otherwise(2 * tail))))


def drift_report(baseline: DataFrame, baseline_counts: DataFrame, current: DataFrame,
                 alpha: float = ALPHA) -> DataFrame:
    """Status per baseline column: missing, insufficient_data or ok, with drift, p-value, distance and means.

    ``baseline`` is a profile, ``baseline_counts`` its value table, ``current`` a plain table.
    """
    wanted = [r["column"] for r in baseline.select("column").distinct().collect()]
    shared = [c for c in numeric_columns(current) if c in wanted]
    here = current.sparkSession.createDataFrame([(c,) for c in current.columns] or [("",)], "column string") \
        .withColumn("_here", F.lit(True))
    if shared:
        distances = ks_distances(baseline_counts, baseline_values(current, shared))
        means = baseline_profile(current, shared).select("column", F.col("mean").alias("current_mean"))
    else:
        distances = current.sparkSession.createDataFrame([], "column string, n long, m long, ks_stat double")
        means = current.sparkSession.createDataFrame([], "column string, current_mean double")
    joined = (baseline.select("column", F.col("mean").alias("baseline_mean"))
              .join(F.broadcast(here), "column", "left").join(F.broadcast(distances), "column", "left")
              .join(F.broadcast(means), "column", "left"))
    enough = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("m", F.lit(0)) > 0)
    status = F.when(F.col("_here").isNull(), "missing").when(~enough, "insufficient_data").otherwise("ok")
    p = asymptotic_p(F.col("ks_stat"), F.col("n").cast("double"), F.col("m").cast("double"))
    ok = F.col("status") == "ok"
    return (joined.withColumn("status", status).withColumn("p_value", F.when(ok, p))
            .select("column", "status",
                    F.when(F.col("status") == "missing", True).when(ok, F.col("p_value") < alpha).otherwise(False)
                    .alias("drift"),
                    "p_value", F.when(ok, F.col("ks_stat")).alias("ks_stat"),
                    F.when(ok, F.col("current_mean")).alias("current_mean"),
                    F.when(ok, F.col("baseline_mean")).alias("baseline_mean")))


def drift_verdict(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or("drift"), F.lit(False)).alias("drift_detected"))
