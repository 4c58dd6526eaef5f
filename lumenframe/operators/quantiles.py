"""Exact quantiles without holding a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000
SMALL_COLUMN = 50_000
COLUMNS_PER_PASS = 6
CONDITIONS_PER_PASS = 40


def number(name: str) -> Column:
    """A numeric column as double with NaN read as null."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[number(c).alias(c) for c in columns])


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` with one row per non-null numeric cell."""
    return numbers(df, columns).unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())


def summarise(df: DataFrame, columns: list[str]) -> dict:
    """One pass over all columns: ``{column: {n, mean, std, pop, least, most, g1}}`` from one row.

    The row count is under the key ``None``. Few, plain aggregates per column keep the pass inside generated code.
    """
    found: dict = {None: {"rows": 0}}
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = columns[start:start + COLUMNS_PER_PASS]
        measures = []
        for i, c in enumerate(part):
            measures += [F.count(c).alias(f"n_{i}"), F.avg(c).alias(f"mean_{i}"), F.stddev_pop(c).alias(f"pop_{i}"),
                         F.min(c).alias(f"least_{i}"), F.max(c).alias(f"most_{i}"), F.skewness(c).alias(f"g1_{i}")]
        row = numbers(df, part).agg(F.count(F.lit(1)).alias("rows"), *measures).first()
        found[None] = {"rows": row["rows"]}
        for i, c in enumerate(part):
            s = {k: row[f"{k}_{i}"] for k in ("n", "mean", "pop", "least", "most", "g1")}
            s["std"] = s["pop"] * (s["n"] / (s["n"] - 1)) ** 0.5 if s["n"] > 1 else None
            found[c] = s
    return found


def _marks(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int) -> dict:
    """Lower and upper bracket per column and probability, from mergeable sketches."""
    margin = 3.0 / accuracy
    points = [max(0.0, p - margin) for p in probabilities] + [min(1.0, p + margin) for p in probabilities]
    row = numbers(df, columns).agg(*[
        F.percentile_approx(c, points, accuracy).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m_{i}"] for i, c in enumerate(columns)}


def quantile_map(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = ACCURACY,
                 small: int = SMALL_COLUMN, summary: dict | None = None) -> dict:
    """``{column: {p: quantile}}`` with linear interpolation between the two nearest ranks.

    ``percentile_approx`` has a guaranteed rank error of ``n / accuracy``, so it brackets every quantile. A second
    pass counts what lies below the bracket and keeps only the distinct values inside it, about
    ``6 n / accuracy`` per quantile: no task ever sees a whole column. Columns of up to ``small`` values are taken
    whole. Columns without values are left out.
    """
    summary = summary or summarise(df, columns)
    probabilities = sorted(probabilities)
    k = len(probabilities)
    filled = [c for c in columns if summary[c]["n"]]
    if not filled:
        return {}
    large = [c for c in filled if summary[c]["n"] > small]
    marks = _marks(df, large, probabilities, accuracy) if large else {}
    targets = []
    for i, c in enumerate(filled):
        s = summary[c]
        for j, p in enumerate(probabilities):
            lo, hi = (marks[c][j], marks[c][k + j]) if c in marks else (s["least"], s["most"])
            targets.append((i, float(p), lo, hi, (s["n"] - 1) * p))
    wide = numbers(df, filled)
    below = _counts(wide, [F.col(filled[i]) < lo for i, _, lo, _, _ in targets])
    limits = df.sparkSession.createDataFrame(
        [(i, p, lo, hi, int(r), int(-(-r // 1)), r - int(r), b) for (i, p, lo, hi, r), b in zip(targets, below)],
        "i int, p double, lo double, hi double, down long, up long, fraction double, start long")
    cells = []
    for i, c in enumerate(filled):
        inside = F.lit(False)
        for lo, hi in sorted({(t[2], t[3]) for t in targets if t[0] == i}):
            inside = inside | F.col(c).between(lo, hi)
        cells.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.col(c).alias("value"))))
    value = F.col("value")
    kept = (wide.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
            .groupBy("i", "value").agg(F.count(F.lit(1)).alias("copies"))
            .join(F.broadcast(limits), "i").filter(value.between(F.col("lo"), F.col("hi"))))
    upto = Window.partitionBy("i", "p").orderBy("value")
    first, last = F.col("last") - F.col("copies") + 1, F.col("last")
    placed = (kept.withColumn("last", F.col("start") + F.sum("copies").over(upto) - 1)
              .groupBy("i", "p")
              .agg(F.first("fraction").alias("fraction"),
                   F.max(F.when(F.col("down").between(first, last), value)).alias("a"),
                   F.max(F.when(F.col("up").between(first, last), value)).alias("b")))
    result: dict = {}
    for row in placed.collect():
        name = filled[row["i"]]
        if row["a"] is None or row["b"] is None:
            raise ValueError(f"quantile {row['p']} of {name} lies outside its bracket")
        result.setdefault(name, {})[row["p"]] = row["a"] + (row["b"] - row["a"]) * row["fraction"]
    return result


def _counts(df: DataFrame, conditions: list[Column]) -> list[int]:
    """How many rows fulfil each condition."""
    found: list[int] = []
    for start in range(0, len(conditions), CONDITIONS_PER_PASS):
        part = conditions[start:start + CONDITIONS_PER_PASS]
        found += list(df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(part)]).first())
    return found
