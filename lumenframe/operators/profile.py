"""Profile of any table: column types, missing values, distributions, outliers, correlations, insights, report."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lumenframe.functions.text import fixed
from lumenframe.operators.dates import is_blank, read_date
from lumenframe.operators.quantiles import numbers, quantile_map, summarise
from lumenframe.session import materialise

CATEGORY_MAX = 20
CATEGORY_RATIO = 0.2
CATEGORY_MIN_ROWS = 50
OUTLIER_PERCENT = 5
DOMINANCE_PERCENT = 50
STRONG, VERY_STRONG = 0.7, 0.9

# Words in a column name that hint at a prediction target.
TARGET_WORDS = ["churn", "target", "label", "fraud", "default", "attrition", "survived", "outcome", "result",
                "churned", "cancelled", "converted", "purchased", "clicked", "defaulted"]

# The two-valued sets read as yes/no, in sorted order.
YES_NO_PAIRS = [("0", "1"), ("no", "yes"), ("No", "Yes"), ("NO", "YES"), ("false", "true"), ("False", "True")]


def columns_of(df: DataFrame, *kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame, with_boolean: bool = True) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if with_boolean else (T.NumericType,)
    return columns_of(df, *kinds)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(name), F.col(name))
    return F.col(name)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, copies)`` over the non-null cells, one shuffle with map-side combine for all columns."""
    wide = df.select(*[present(df, c).cast("string").alias(c) for c in columns])
    return (wide.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("copies")))


def parse_time(value: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def column_types(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """``(ordinal, column, semantic_type)``: numeric, datetime, categorical, text or unknown.

    A text column is datetime if every value that is not blank is a date, in any form that ``dates`` knows or, if given, in one
    of ``formats``.
    """
    strings = string_columns(df)
    known = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            known[f.name] = "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            known[f.name] = "datetime"
        elif not isinstance(f.dataType, T.StringType):
            known[f.name] = "unknown"
    listed = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(known.get(c)).cast("string")
                 .alias("known")) for i, c in enumerate(df.columns)]))
    base = df.agg(F.count(F.lit(1)).alias("rows")).select("rows", listed.alias("c")).select("rows", "c.*")
    if not strings:
        return base.select("ordinal", "column", F.col("known").alias("semantic_type"))
    shape = value_counts(df, strings).groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.count_if(parse_time(F.col("value"), formats).isNotNull() if formats else
                   read_date(F.col("value"))["form"].isNotNull()).alias("dates"),
        F.count_if(is_blank(F.col("value"))).alias("blanks"))
    distinct = F.coalesce("distinct_values", F.lit(0))
    dates = F.coalesce("dates", F.lit(0))
    few = (distinct <= CATEGORY_MAX) | ((F.col("rows") > CATEGORY_MIN_ROWS)
                                        & (F.try_divide(distinct, F.col("rows")) < CATEGORY_RATIO))
    kind = (F.when(F.col("known").isNotNull(), F.col("known"))
            .when((dates > 0) & (dates + F.coalesce("blanks", F.lit(0)) == distinct), "datetime")
            .when(few, "categorical").otherwise("text"))
    return base.join(F.broadcast(shape), "column", "left").select("ordinal", "column", kind.alias("semantic_type"))


def missing_values(df: DataFrame) -> DataFrame:
    """``(ordinal, column, rows, columns, missing_count, missing_percentage)`` from one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    entries = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                 (F.col("rows") - F.col(f"n{i}")).alias("missing_count")) for i, c in enumerate(df.columns)]))
    return (counted.select("rows", F.lit(len(df.columns)).alias("columns"), entries.alias("e"))
            .select("e.ordinal", "e.column", "rows", "columns", "e.missing_count",
                    F.round(F.try_divide(F.col("e.missing_count"), F.col("rows")) * 100, 2)
                    .alias("missing_percentage")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group; nulls are equal."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def table_bytes(df: DataFrame) -> DataFrame:
    """Estimated bytes: fixed width or text length per cell."""
    widths = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    terms = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            terms.append(F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)))
        else:
            terms.append(F.count(f.name) * widths.get(type(f.dataType), 8))
    total = sum(terms[1:], terms[0])
    return df.agg(total.cast("long").alias("bytes")).withColumn(
        "memory_usage_mb", F.round(F.col("bytes") / (1024 * 1024), 2))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments, exact quartiles, box-plot outliers and skew per column; columns without values are left out.

    Three passes: moments and quantile brackets, quartiles, outlier counts. Only one number per column and measure
    reaches the driver.
    """
    columns = numeric_columns(df) if columns is None else columns
    quarters = [0.25, 0.5, 0.75]
    summary = summarise(df, columns)
    quantiles = quantile_map(df, columns, quarters, summary=summary)
    columns_left = [c for c in columns if c in quantiles]
    if not columns_left:
        return _empty_numeric(df)
    entries, counts = [], []
    for i, c in enumerate(columns):
        if c not in quantiles:
            continue
        s = summary[c]
        q1, median, q3 = (quantiles[c][p] for p in quarters)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        counts.append(F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(f"_o{i}"))
        skew = None
        if s["n"] >= 3:
            skew = 0.0 if s["g1"] is None else s["g1"] * math.sqrt(s["n"] * (s["n"] - 1)) / (s["n"] - 2)
        label = (None if skew is None else "symmetric" if abs(skew) < 0.5 else
                 "right-skewed" if skew > 0 else "left-skewed")
        measures = {"mean": s["mean"], "median": median, "std": s["std"], "min": s["least"], "max": s["most"],
                    "q1": q1, "q3": q3, "iqr": q3 - q1, "skewness": skew}
        entries.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
            *[(F.round(F.lit(v).cast("double"), 4) + 0.0).alias(k) for k, v in measures.items()],
            F.lit(label).cast("string").alias("skew_label"), F.col(f"_o{i}").alias("outlier_count"),
            F.round(F.col(f"_o{i}") / F.lit(s["n"]) * 100, 2).alias("outlier_percentage"),
            F.lit(summary[None]["rows"] - s["n"]).cast("long").alias("missing_count")))
    counted = numbers(df, columns_left).agg(*counts)
    return counted.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def top_values(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """Most frequent values per column; equal counts are ordered by value."""
    order = Window.partitionBy("column").orderBy(F.col("copies").desc(), F.col("value"))
    return (value_counts(df, columns).withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= limit))


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct count, mode, its share and missing count per column."""
    columns = string_columns(df) if columns is None else columns
    counts = value_counts(df, columns)
    rows = df.agg(F.count(F.lit(1))).scalar()
    mode = F.min(F.struct((-F.col("copies")).alias("neg"), F.col("value")))
    ordinal = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1
    return (counts.groupBy("column")
            .agg(F.count(F.lit(1)).alias("unique_count"), mode.alias("_mode"), F.sum("copies").alias("_n"))
            .select(ordinal.cast("int").alias("ordinal"), "column", "unique_count",
                    F.col("_mode.value").alias("most_common"), (-F.col("_mode.neg")).alias("most_common_count"),
                    F.round(-F.col("_mode.neg") / F.col("_n") * 100, 2).alias("most_common_percentage"),
                    (rows - F.col("_n")).alias("missing_count")))


def pair_moments(df: DataFrame, columns: list[str], centre: dict) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` over the rows where both columns are present.

    Every batch is reduced to one small matrix per measure, so the work per row is a matrix product and the
    shuffle carries ``columns^2`` rows per task at most.
    """
    middle = np.array([centre[c]["mean"] or 0.0 for c in columns])
    upper = np.triu_indices(len(columns))

    def reduce(batches):
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - middle
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            square = x * x
            part = np.stack([here.T @ here, x.T @ here, here.T @ x, square.T @ here, here.T @ square, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": upper[0], "j": upper[1],
                                **{k: total[m][upper] for m, k in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}})

    parts = numbers(df, columns).mapInPandas(
        reduce, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(i, j, column_a, column_b, correlation)`` for every pair i <= j over the rows where both are present.

    Pearson, rounded to 4 places, null when one side is constant.
    """
    columns = numeric_columns(df) if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, column_a string, column_b string, correlation double")
    centre = summarise(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    # A spread below the rounding noise of the values counts as constant.
    noise = F.array(*[F.lit(1e-24 * max(abs(centre[c]["least"] or 0.0), abs(centre[c]["most"] or 0.0)) ** 2)
                      for c in columns])
    vx = F.try_divide(F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n")), F.col("n"))
    vy = F.try_divide(F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n")), F.col("n"))
    cov = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.col("n"))
    spread = (F.col("vx") > noise[F.col("i")]) & (F.col("vy") > noise[F.col("j")])
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("cov"), F.sqrt("vx") * F.sqrt("vy"))))
    return (pair_moments(df, columns, centre)
            .withColumn("vx", vx).withColumn("vy", vy).withColumn("cov", cov)
            .select("i", "j", names[F.col("i")].alias("column_a"), names[F.col("j")].alias("column_b"),
                    F.when(spread, F.round(r, 4)).alias("correlation")))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full matrix in long form."""
    upper = correlations(df, columns)
    lower = upper.filter(F.col("i") < F.col("j")).select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    return upper.select("column_a", "column_b", "correlation").unionByName(lower)


def strong_pairs(pairs: DataFrame) -> DataFrame:
    r = F.col("correlation")
    return (pairs.filter((F.col("i") < F.col("j")) & (F.abs(r) > STRONG))
            .withColumn("strength", F.when(F.abs(r) > VERY_STRONG, "very strong").otherwise("strong"))
            .withColumn("direction", F.when(r > 0, "positive").otherwise("negative")))


def plain_number(value: Column) -> Column:
    """Shortest decimal text of a number rounded to 4 places, never in scientific form."""
    text = F.regexp_replace(value.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    return text


def insights(numeric: DataFrame, categorical: DataFrame, pairs: DataFrame, missing: DataFrame,
             duplicates: DataFrame) -> DataFrame:
    """``(priority, ordinal, step, insight)``: ranked findings from the small profile frames."""
    def line(priority: int, ordinal: Column, step: int, text: Column) -> list[Column]:
        return [F.lit(priority).alias("priority"), ordinal.cast("int").alias("ordinal"), F.lit(step).alias("step"),
                text.alias("insight")]

    zero = F.lit(0)
    whole = lambda c: F.format_number(F.col(c).cast("long"), 0)
    totals = missing.agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"),
                         F.sum("missing_count").alias("missing"),
                         F.max(F.struct("missing_percentage", (-F.col("ordinal")).alias("o"), F.col("column")))
                         .alias("worst"))
    size = totals.select(*line(1, zero, 0, F.concat(
        F.lit("Dataset contains "), whole("rows"), F.lit(" rows and "), F.col("columns").cast("string"),
        F.lit(" columns."))))
    gaps = totals.select(*line(2, zero, 0, F.when(F.col("missing") > 0, F.concat(
        F.lit("Missing values detected: "), whole("missing"), F.lit(" total. Worst column: '"),
        F.col("worst.column"), F.lit("' with "), plain_number(F.col("worst.missing_percentage")),
        F.lit("% missing."))).otherwise("No missing values detected. Dataset is complete.")))
    copies = duplicates.filter(F.col("duplicate_rows") > 0).select(*line(3, zero, 0, F.concat(
        F.lit("Found "), whole("duplicate_rows"), F.lit(" duplicate rows ("),
        plain_number(F.round(F.col("duplicate_rows") / F.col("rows") * 100, 1)), F.lit("% of data)."))))
    outlying = numeric.filter(F.col("outlier_percentage") > OUTLIER_PERCENT).select(*line(4, F.col("ordinal"), 0, F.concat(
        F.lit("Column '"), F.col("column"), F.lit("' has "), plain_number(F.col("outlier_percentage")),
        F.lit("% outliers. Range: "), plain_number(F.col("min")), F.lit(" to "), plain_number(F.col("max")),
        F.lit(". Distribution is "), F.col("skew_label"), F.lit("."))))
    skewed = numeric.filter(F.col("skew_label") != "symmetric").select(*line(4, F.col("ordinal"), 1, F.concat(
        F.lit("Column '"), F.col("column"), F.lit("' is "), F.col("skew_label"), F.lit(" (skewness="),
        plain_number(F.col("skewness")), F.lit("). Median ("), plain_number(F.col("median")),
        F.lit(") differs from mean ("), plain_number(F.col("mean")), F.lit(")."))))
    dominant = (categorical.filter(F.col("most_common_percentage") > DOMINANCE_PERCENT)
                .select(*line(5, F.col("ordinal"), 0, F.concat(
                    F.lit("Column '"), F.col("column"), F.lit("' is dominated by '"), F.col("most_common"),
                    F.lit("' ("), plain_number(F.col("most_common_percentage")), F.lit("% of values). Only "),
                    F.col("unique_count").cast("string"), F.lit(" unique values total.")))))
    linked = strong_pairs(pairs).select(*line(6, F.col("i") * 10_000 + F.col("j"), 0, F.concat(
        F.lit("Strong "), F.col("direction"), F.lit(" correlation ("), plain_number(F.col("correlation")),
        F.lit(") between '"), F.col("column_a"), F.lit("' and '"), F.col("column_b"), F.lit("'."))))
    found = size
    for part in (gaps, copies, outlying, skewed, dominant, linked):
        found = found.unionByName(part)
    return found


def profile_table(df: DataFrame, formats: list[str] | None = None) -> dict[str, DataFrame]:
    """Every profile frame of one table. The column types decide what counts as categorical."""
    types = materialise(column_types(df, formats), "column-types")
    kinds = {r["column"]: r["semantic_type"] for r in types.collect()}
    numeric_names = [c for c in df.columns if kinds.get(c) == "numeric"]
    category_names = [c for c in df.columns if kinds.get(c) == "categorical"]
    numeric = numeric_profile(df, numeric_names) if numeric_names else _empty_numeric(df)
    category = categorical_profile(df, category_names) if category_names else _empty_categorical(df)
    pairs = correlations(df, numeric_names)
    parts = {"types": types, "missing": missing_values(df), "duplicates": duplicate_rows(df), "numeric": numeric,
             "categorical": category, "correlations": pairs}
    parts = {name: materialise(frame, f"profile-{name}") for name, frame in parts.items()}
    parts["insights"] = insights(parts["numeric"], parts["categorical"], parts["correlations"], parts["missing"],
                                 parts["duplicates"])
    return parts


def _empty_numeric(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], (
        "ordinal int, column string, mean double, median double, std double, min double, max double, q1 double, "
        "q3 double, iqr double, skewness double, skew_label string, outlier_count bigint, "
        "outlier_percentage double, missing_count bigint"))


def _empty_categorical(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], (
        "ordinal int, column string, unique_count bigint, most_common string, most_common_count bigint, "
        "most_common_percentage double, missing_count bigint"))


# Report --------------------------------------------------------------------------------------------------------

# Report phrases per language.
PHRASES = {
    "en": {"head": "I analysed **%s** containing %d rows and %d columns.\n\n", "insights": "**Statistical insights:**\n",
           "model": "**Best model:** %s (R² = %s%%)\n\n",
           "found": "**Anomalies detected:** %d suspicious rows found.\n",
           "none": "**Anomalies:** No anomalies detected.\n"},
    "fr": {"head": "J'ai analysé le fichier **%s** contenant %d lignes et %d colonnes.\n\n",
           "insights": "**Insights statistiques :**\n", "model": "**Meilleur modèle :** %s (R² = %s%%)\n\n",
           "found": "**Anomalies détectées :** %d lignes suspectes trouvées.\n",
           "none": "**Anomalies :** Aucune anomalie détectée.\n"},
}


def first_insights(found: DataFrame, limit: int = 3) -> Column:
    """The first insights as an array value."""
    top = found.orderBy("priority", "ordinal", "step").limit(limit)
    listed = F.sort_array(F.collect_list(F.struct("priority", "ordinal", "step", "insight")))
    return top.agg(F.transform(listed, lambda e: e["insight"])).scalar()


def summary_report(facts: DataFrame, found: DataFrame) -> DataFrame:
    """One report per row of ``facts`` (file_name, rows, columns, anomaly_count, best_model, r2, language)."""
    lines = F.col("_lines")

    def build(words: dict[str, str]) -> Column:
        bullet = F.concat(F.lit(words["insights"]), F.array_join(
            F.transform(lines, lambda s: F.concat(F.lit("- "), s, F.lit("\n"))), ""), F.lit("\n"))
        has_model = F.col("best_model").isNotNull() & (F.coalesce("r2", F.lit(0.0)) != 0)
        return F.concat(
            F.format_string(words["head"], "file_name", "rows", "columns"),
            F.when(F.size(lines) > 0, bullet).otherwise(""),
            F.when(has_model, F.format_string(words["model"], F.col("best_model"), fixed(F.col("r2") * 100, 2))).otherwise(""),
            F.when(F.col("anomaly_count") > 0, F.format_string(words["found"], "anomaly_count"))
            .otherwise(words["none"]))

    return (facts.withColumn("_lines", first_insights(found))
            .withColumn("report", F.when(F.col("language") == "en", build(PHRASES["en"]))
                        .otherwise(build(PHRASES["fr"]))).drop("_lines"))


def narrative_report(facts: DataFrame, found: DataFrame) -> DataFrame:
    """French narrative with metrics, top features and severities.

    ``facts``: file_name, rows, columns, best_model, metrics (array of name/value structs), top_features (array of
    names), anomaly_count, anomaly_rate, high, medium, low.
    """
    lines = F.col("_lines")
    metric_text = F.array_join(F.transform(F.slice("metrics", 1, 3), lambda m: F.concat(
        m["name"], F.lit(": "), fixed(m["value"], 3))), ", ")
    parts = F.array(
        F.concat(F.lit("J'ai analysé le fichier **"), F.col("file_name"), F.lit("** contenant "),
                 F.format_number("rows", 0), F.lit(" lignes et "), F.col("columns").cast("string"),
                 F.lit(" colonnes.")),
        F.when(F.size(lines) > 0, F.concat(F.lit("\n**Insights statistiques :**\n"), F.array_join(
            F.transform(lines, lambda s: F.concat(F.lit("- "), s)), "\n"))),
        F.when(F.col("best_model").isNotNull() & (F.size("metrics") > 0), F.format_string(
            "\n**Modèle ML :** %s (%s)", F.col("best_model"), metric_text)),
        F.when(F.size("top_features") > 0, F.concat(
            F.lit("\n**Variables les plus importantes :** "), F.array_join(F.slice("top_features", 1, 3), ", "))),
        F.when(F.col("anomaly_count") > 0, F.format_string(
            "\n**Anomalies détectées :** %d anomalies (%s%% des données) — %d critiques, %d moyennes, %d faibles.",
            F.col("anomaly_count"), fixed(F.col("anomaly_rate"), 1), F.col("high"), F.col("medium"), F.col("low")))
        .otherwise("\n**Anomalies :** Aucune anomalie détectée."))
    return (facts.withColumn("_lines", first_insights(found))
            .withColumn("report", F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")).drop("_lines"))


# Target column -------------------------------------------------------------------------------------------------

def binary_columns(df: DataFrame) -> DataFrame:
    """``(ordinal, column, low, high)`` of the columns with exactly two distinct values.

    A column is two-valued when nothing lies beside its least and greatest value: two passes without a shuffle.
    """
    columns = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType,
                                          T.TimestampNTZType))]
    wide = df.select(*[present(df, c).alias(c) for c in columns])
    ends = wide.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
                    *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)]).first()

    def end(side: str, i: int) -> Column:
        return F.lit(ends[f"{side}{i}"]).cast(wide.schema[columns[i]].dataType)

    checked = wide.agg(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.min(c).cast("string").alias("low"),
                 F.max(c).cast("string").alias("high"),
                 F.count_if((F.col(c) != end("lo", i)) & (F.col(c) != end("hi", i))).alias("others"))
        .alias(f"_b{i}") for i, c in enumerate(columns)])
    return (checked.select(F.explode(F.array(*[f"_b{i}" for i in range(len(columns))])).alias("b")).select("b.*")
            .filter((F.col("others") == 0) & (F.col("low") != F.col("high"))).drop("others"))


def detect_target(df: DataFrame) -> DataFrame:
    """The likeliest target column: a two-valued column with a telling name, else one with yes/no values."""
    name = F.lower("column")
    telling = F.lit(False)
    for word in TARGET_WORDS:
        telling = telling | name.contains(word)
    trimmed = [F.regexp_replace(c, r"\.0$", "") for c in ("low", "high")]
    pair = F.lit(False)
    for low, high in YES_NO_PAIRS:
        pair = pair | ((trimmed[0] == low) & (trimmed[1] == high))
    return (binary_columns(df).withColumn("priority", F.when(telling, 1).when(pair, 2))
            .filter(F.col("priority").isNotNull()).orderBy("priority", "ordinal").limit(1)
            .select("column", "priority"))
