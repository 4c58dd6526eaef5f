"""Ordered operations that stay balanced when one group holds a large share of the rows.

A plain window sends a whole group to one task. Here a group is first cut into ordered pieces; the window runs
inside a piece, and a small frame with one row per piece carries values across the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_ROWS = 1_000_000
MOST_HOT_GROUPS = 10_000
LEAST_PIECES = 64


def same(left: list[str], right: list[str]) -> Column:
    """Equality of key columns in which nulls are equal."""
    found = F.lit(True)
    for a, b in zip(left, right):
        found = found & F.col(a).eqNullSafe(F.col(b))
    return found


def running_sums(df: DataFrame, keys: list[str], bucket: str, order: list[str],
                 amounts: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per ``keys`` over the order ``(bucket, *order)``, one column per amount.

    ``bucket`` must grow with ``order``. The second level sees one row per bucket only.
    """
    names = list(amounts)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(a).alias(f"_t_{n}") for n, a in amounts.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    known = [f"_k_{c}" for c in [*keys, bucket]]
    offsets = totals.select(*[F.col(c).alias(k) for c, k in zip([*keys, bucket], known)], *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    inside = (Window.partitionBy(*keys, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = df.columns
    return (df.select(*kept, *[F.sum(a).over(inside).alias(f"_i_{n}") for n, a in amounts.items()])
            .join(offsets, same([*keys, bucket], known))
            .select(*kept, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]))


def split_row_number(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """``row_number`` per ``keys`` over the order ``(bucket, *order)``, 1-based and without gaps."""
    return running_sums(df, keys, bucket, order, {name: F.lit(1)})


def hot_edges(df: DataFrame, keys: list[str], measure: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cut points of ``measure`` for the groups that hold at least ``hot_rows`` rows and one row in
    ``MOST_HOT_GROUPS`` of all. There can't be more than ``MOST_HOT_GROUPS`` of them, which bounds the broadcast, and
    each is cut into pieces of about ``hot_rows`` rows.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.sum("_n"), F.max("_n")).first()
    total, largest = seen[0] or 0, seen[1] or 0
    hot = sizes.filter(F.col("_n") >= max(hot_rows, -(-total // MOST_HOT_GROUPS))).drop("_n")
    pieces = max(LEAST_PIECES, -(-largest // hot_rows))
    probabilities = [i / pieces for i in range(1, pieces)]
    return (df.select(*keys, measure).join(F.broadcast(hot), keys, "left_semi")
            .groupBy(*keys)
            .agg(F.array_distinct(F.percentile_approx(measure, probabilities, max(1000, 10 * pieces))).alias("_edges")))


def with_neighbour(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                   step: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``lead`` (step 1) or ``lag`` (step -1) of ``value`` per ``keys``; null at the end of a group.

    The first column of ``order`` must be numeric, a date or a timestamp: hot groups are cut along it. Key columns
    must not be null.
    """
    measure = order[0]
    edges = hot_edges(df, keys, measure, hot_rows)
    cut = (df.join(F.broadcast(edges), keys, "left")
           .withColumn("_piece", F.when(F.col("_edges").isNull(), F.lit(0))
                       .otherwise(F.size(F.filter("_edges", lambda e: e <= F.col(measure)))))
           .withColumn("_value", F.struct(value.alias("v"))))
    direction = [F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, "_piece").orderBy(*direction)
    across = Window.partitionBy(*keys).orderBy("_piece")
    rank = F.struct(*order)
    if step == 1:
        near, pick, shift = F.lead("_value").over(inside), F.min_by("_value", rank), F.lead("_edge")
    else:
        near, pick, shift = F.lag("_value").over(inside), F.max_by("_value", rank), F.lag("_edge")
    ends = (cut.filter(F.col("_edges").isNotNull()).groupBy(*keys, "_piece").agg(pick.alias("_edge"))
            .select(*keys, "_piece", shift.over(across).alias("_beyond")))
    return (cut.withColumn("_near", near)
            .join(F.broadcast(ends), [*keys, "_piece"], "left")
            .withColumn(name, F.coalesce(F.col("_near"), F.col("_beyond"))["v"])
            .drop("_edges", "_piece", "_value", "_near", "_beyond"))


def newest_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per group. Spark limits each group before the shuffle, so hot groups stay small."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= limit).drop("_rank")
