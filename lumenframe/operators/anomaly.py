"""Anomaly scores: robust distance, histograms, nearest neighbours and isolation trees, and their ensemble."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lumenframe.operators.ordered import split_row_number
from lumenframe.operators.profile import present, string_columns, value_counts
from lumenframe.operators.quantiles import quantile_map, summarise
from lumenframe.session import materialise

HIGH, MEDIUM = 0.7, 0.4
CONTAMINATION = 0.05
MIN_ROWS = 10
ENSEMBLE_WEIGHT, DISTANCE_WEIGHT = 0.7, 0.3
BINS, BIN_FLOOR, EDGE_SLACK = 10, 0.1, 1e-9
NEIGHBOURS = 5
TREES, TREE_ROWS, POOL_ROWS = 100, 256, 65_536
SMALL_DICTIONARY = 100_000
EDGE_SAMPLE = 256


def feature_columns(df: DataFrame, key: str) -> list[str]:
    """Numeric (not boolean) and string columns, in table order."""
    return [f.name for f in df.schema.fields
            if f.name != key and isinstance(f.dataType, (T.NumericType, T.StringType))]


# Matrix --------------------------------------------------------------------------------------------------------

def ordinal_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, code)``: position of each distinct value in sorted order, from 0.

    The values are cut at sampled edges, so that a column with very many distinct texts is ranked by many tasks.
    """
    values = materialise(value_counts(df, columns).select("column", "value"), "values")
    order = Window.partitionBy("column").orderBy(F.xxhash64("value"), "value")
    sample = (values.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= EDGE_SAMPLE)
              .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("edges")))
    cut = (values.join(F.broadcast(sample), "column")
           .withColumn("bucket", F.size(F.filter("edges", lambda e: e <= F.col("value")))).drop("edges"))
    ranked = split_row_number(cut, ["column"], "bucket", ["value"], "_n")
    return ranked.select("column", "value", (F.col("_n") - 1).cast("double").alias("code"))


def encode(df: DataFrame, columns: list[str], codes: DataFrame | None = None, unseen: float = -1.0) -> DataFrame:
    """String columns replaced by their codes; nulls stay null, unknown values become ``unseen``.

    A dictionary is broadcast only after its size has been checked.
    """
    if not columns:
        return df
    codes = materialise(ordinal_codes(df, columns) if codes is None else codes, "codes")
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in columns:
        mine = codes.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        if sizes.get(c, 0) <= SMALL_DICTIONARY:
            mine = F.broadcast(mine)
        df = (df.join(mine, c, "left")
              .withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("_code", F.lit(unseen)))).drop("_code"))
    return df


def encoded_matrix(df: DataFrame, key: str, features: list[str] | None = None) -> DataFrame:
    """``key`` and one double column per feature; nulls are kept."""
    features = features or feature_columns(df, key)
    strings = [c for c in features if c in string_columns(df)]
    plain = df.select(key, *[present(df, c).alias(c) if c in strings else F.col(c) for c in features])
    coded = encode(plain, strings)
    return coded.select(key, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
                               for c in features])


def impute(matrix: DataFrame, features: list[str], medians: dict | None = None) -> DataFrame:
    """Nulls replaced by the exact median of their column. A column without gaps needs none."""
    if not medians:
        s = summarise(matrix, features) if features else {}
        gaps = [c for c in features if s[c]["n"] < s[None]["rows"]]
        medians = {c: q[0.5] for c, q in quantile_map(matrix, gaps, [0.5], summary=s).items()} if gaps else {}
    kept = [c for c in matrix.columns if c not in features]
    return matrix.select(*kept, *[F.coalesce(F.col(c), F.lit(medians.get(c, 0.0))).alias(c) for c in features])


def scale(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant column is only centred."""
    s = summarise(matrix, features)
    kept = [c for c in matrix.columns if c not in features]
    return matrix.select(*kept, *[
        ((F.col(c) - F.lit(s[c]["mean"])) / F.lit(_deviation(s[c]))).alias(c) for c in features])


def _deviation(summary: dict) -> float:
    noise = 1e-12 * max(abs(summary["least"] or 0.0), abs(summary["most"] or 0.0))
    return summary["pop"] if summary["pop"] and summary["pop"] > noise else 1.0


def scaled_matrix(df: DataFrame, key: str, features: list[str] | None = None) -> DataFrame:
    """Encoded, imputed and scaled, written once: every score below reads it."""
    features = features or feature_columns(df, key)
    encoded = materialise(encoded_matrix(df, key, features), "encoded")
    return materialise(scale(impute(encoded, features), features), "scaled")


# Scores --------------------------------------------------------------------------------------------------------

def distance_scores(df: DataFrame, key: str, columns: list[str], name: str = "distance_score") -> DataFrame:
    """Distance from the median in interquartile ranges, squashed, summed over columns, divided by the maximum."""
    wide = df.select(key, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
                            for c in columns])
    medians = {c: q[0.5] for c, q in quantile_map(wide, columns, [0.5]).items()}
    filled = impute(wide, columns, medians)
    quarters = quantile_map(filled, columns, [0.25, 0.5, 0.75])
    total = F.lit(0.0)
    for c in columns:
        q = quarters.get(c)
        if q and q[0.75] > q[0.25]:
            d = F.abs(F.col(c) - q[0.5]) / (q[0.75] - q[0.25])
            total = total + (1 - 1 / (1 + d / 3))
    scored = filled.select(key, total.alias(name))
    top = scored.agg(F.max(name)).first()[0]
    return scored.withColumn(name, F.col(name) / top) if top and top > 0 else scored


def histogram_scores(matrix: DataFrame, key: str, features: list[str], bins: int = BINS,
                     name: str = "histogram_score") -> DataFrame:
    return with_histogram_score(matrix, features, bins, name).select(key, name)


def with_histogram_score(matrix: DataFrame, features: list[str], bins: int = BINS,
                         name: str = "histogram_score") -> DataFrame:
    """Minus the summed log density of the row's bin in each column, over ``bins`` equal-width bins.

    Added to the matrix as a plain expression: no join.
    """
    s = summarise(matrix, features)
    n = s[None]["rows"]
    positions, widths = {}, {}
    for c in features:
        low, high = s[c]["least"], s[c]["most"]
        if high == low:
            low, high = low - 0.5, high + 0.5
        widths[c] = (high - low) / bins
        # A value on an edge belongs to the upper bin, whatever the rounding of the scaled value.
        positions[c] = F.least(F.floor((F.col(c) - low) / widths[c] + EDGE_SLACK), F.lit(bins - 1)).cast("int")
    binned = matrix.select(*[positions[c].alias(c) for c in features])
    counted = (binned.unpivot([], features, "feature", "bin").groupBy("feature", "bin")
               .agg(F.count(F.lit(1)).alias("n")).collect())
    score = F.lit(0.0)
    for c in features:
        table = {r["bin"]: math.log2(r["n"] / (n * widths[c]) + BIN_FLOOR) for r in counted if r["feature"] == c}
        score = score - F.array(*[F.lit(float(table.get(b, math.log2(BIN_FLOOR)))) for b in range(bins)])[positions[c]]
    return matrix.withColumn(name, score)


def min_max(scores: DataFrame, names: list[str]) -> DataFrame:
    """Each score mapped to 0..1; a constant score becomes 0."""
    ends = scores.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in names]).first()
    kept = [c for c in scores.columns if c not in names]
    mapped = []
    for c in names:
        lo, hi = ends[c]["lo"], ends[c]["hi"]
        mapped.append(((F.col(c) - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0)).alias(c))
    return scores.select(*kept, *mapped)


def label(scores: DataFrame, name: str = "ensemble_score", contamination: float = CONTAMINATION) -> DataFrame:
    """1 where the score reaches the exact percentile ``1 - contamination``."""
    p = 1 - contamination
    threshold = quantile_map(scores, [name], [p])[name][p]
    return scores.withColumn("label", F.when(F.col(name) >= threshold, 1).otherwise(0))


def severity(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


# Isolation forest ----------------------------------------------------------------------------------------------

def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _below(share: float) -> int:
    """Upper bound of a 64-bit hash that a random ``share`` of the rows stays under."""
    return min(2 ** 63 - 1, int(-(2 ** 63) + share * 2.0 ** 64))


def isolation_trees(matrix: DataFrame, key: str, features: list[str], trees: int = TREES, rows: int = TREE_ROWS,
                    seed: int = 42) -> list[dict]:
    """Random trees, each over its own hash sample of ``rows`` rows. What returns is bounded by ``trees * rows``."""
    n = matrix.count()
    sample_rows = min(rows, n)
    # One hash per row keeps a random pool for all trees; each tree then draws from the pool alone.
    pool = _below(min(1.0, max(trees * rows, POOL_ROWS) / n) if n else 1.0)
    share = _below(min(1.0, 8.0 * sample_rows / min(n, max(trees * rows, POOL_ROWS))) if n else 1.0)
    drawn = (matrix.withColumn("_k", F.xxhash64(F.col(key), F.lit(seed))).filter(F.col("_k") <= pool)
             .withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                                                    lambda t: F.xxhash64("_k", t) <= share)))
             .withColumn("_h", F.xxhash64("_k", "tree")))
    rank = Window.partitionBy("tree").orderBy("_h", key)
    drawn = drawn.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= sample_rows)
    depth = math.ceil(math.log2(max(sample_rows, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_h")[features].to_numpy(dtype=float)
        random = np.random.default_rng([seed, tree])
        feature, cut, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, level: int) -> int:
            i = len(feature)
            for column in (feature, cut, left, right, path):
                column.append(-1.0)
            spread = part.max(axis=0) - part.min(axis=0)
            usable = np.flatnonzero(spread > 0)
            if level >= depth or len(part) <= 1 or not len(usable):
                path[i] = level + average_path(len(part))
                return i
            f = int(random.choice(usable))
            value = float(random.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] <= value
            feature[i], cut[i] = f, value
            left[i], right[i] = node(part[low], level + 1), node(part[~low], level + 1)
            return i

        node(x, 0)
        return pd.DataFrame({"tree": tree, "feature": [[int(v) for v in feature]], "cut": [cut],
                             "left": [[int(v) for v in left]], "right": [[int(v) for v in right]], "path": [path]})

    schema = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"
    grown = drawn.select("tree", "_h", *features).groupBy("tree").applyInPandas(grow, schema).collect()
    return [{"rows": sample_rows, **{k: np.array(r[k]) for k in ("feature", "cut", "left", "right", "path")}}
            for r in sorted(grown, key=lambda r: r["tree"])]


def joined_trees(trees: list[dict]) -> dict:
    """All trees in one set of arrays. A leaf leads to itself, so that every row can take the same number of steps."""
    starts = np.cumsum([0, *[len(t["path"]) for t in trees]])[:-1]
    leaf = [t["feature"] < 0 for t in trees]
    own = [start + np.arange(len(t["path"])) for start, t in zip(starts, trees)]

    def lined(parts: list) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0)

    return {"rows": trees[0]["rows"] if trees else 0, "starts": starts.astype(np.intp),
            "steps": math.ceil(math.log2(max(trees[0]["rows"], 2))) if trees else 0,
            "feature": lined([np.where(end, 0, t["feature"]) for end, t in zip(leaf, trees)]).astype(np.intp),
            "cut": lined([np.where(end, np.inf, t["cut"]) for end, t in zip(leaf, trees)]),
            "left": lined([np.where(end, i, start + t["left"]) for end, i, start, t in zip(leaf, own, starts, trees)])
            .astype(np.intp),
            "right": lined([np.where(end, i, start + t["right"]) for end, i, start, t in zip(leaf, own, starts, trees)])
            .astype(np.intp),
            "path": lined([t["path"] for t in trees])}


def mean_depth(x: np.ndarray, forest: dict, block: int = 512) -> np.ndarray:
    """Mean path of each row over all trees, which are walked together, a block of rows at a time."""
    found = np.zeros(len(x))
    for start in range(0, len(x), block):
        part = x[start:start + block]
        row = np.arange(len(part))[:, None] * part.shape[1]
        at = np.broadcast_to(forest["starts"], (len(part), len(forest["starts"])))
        values = part.ravel()
        for _ in range(forest["steps"]):
            low = values.take(row + forest["feature"].take(at)) <= forest["cut"].take(at)
            at = np.where(low, forest["left"].take(at), forest["right"].take(at))
        found[start:start + block] = forest["path"].take(at).mean(axis=1)
    return found


def isolation_scores(matrix: DataFrame, key: str, features: list[str], trees: int = TREES, rows: int = TREE_ROWS,
                     seed: int = 42, name: str = "isolation_score") -> DataFrame:
    return with_isolation_score(matrix.select(key, *features), key, features, trees, rows, seed, name).select(key, name)


def with_isolation_score(matrix: DataFrame, key: str, features: list[str], trees: int = TREES, rows: int = TREE_ROWS,
                         seed: int = 42, name: str = "isolation_score") -> DataFrame:
    """``2^(-mean depth / c)`` per row: near 1 for rows that random cuts isolate early. No shuffle of the rows."""
    forest = joined_trees(isolation_trees(matrix, key, features, trees, rows, seed))
    shared = matrix.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for pdf in batches:
            depth = mean_depth(pdf[features].to_numpy(dtype=float), shared.value)
            yield pdf.assign(**{name: 2.0 ** (-depth / (average_path(shared.value["rows"]) or 1.0))})

    return matrix.mapInPandas(score, T.StructType([*matrix.schema.fields, T.StructField(name, T.DoubleType())]))


# Ensemble ------------------------------------------------------------------------------------------------------

def anomaly_scores(df: DataFrame, key: str, contamination: float = CONTAMINATION, seed: int = 42,
                   models: tuple = ("isolation", "histogram", "neighbour"), k: int = NEIGHBOURS,
                   neighbours: str = "exact") -> DataFrame:
    """Per row: model scores in 0..1, their mean, the label, the robust distance and the hybrid score.

    ``neighbours`` is exact or approximate; the latter is for ten columns and more.
    """
    from lumenframe.operators.near_trees import approximate_scores
    from lumenframe.operators.neighbours import neighbour_scores
    if neighbours not in ("exact", "approximate"):
        raise ValueError("neighbours must be exact or approximate")
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed")
    features = feature_columns(df, key)
    if not features:
        raise ValueError("no usable columns")
    matrix = scaled_matrix(df, key, features)
    # Two models only add a column; the neighbours and the robust distance come by one join each.
    scores = matrix
    if "histogram" in models:
        scores = with_histogram_score(scores, features)
    if "isolation" in models:
        scores = with_isolation_score(scores, key, features, seed=seed)
    scores = scores.drop(*features)
    if "neighbour" in models:
        kth = neighbour_scores if neighbours == "exact" else approximate_scores
        scores = scores.join(kth(matrix, key, features, k), key)
    numeric = [c for c in features if c not in string_columns(df)]
    if numeric:
        scores = scores.join(distance_scores(df, key, numeric), key)
    else:
        scores = scores.withColumn("distance_score", F.lit(0.0))
    names = [f"{m}_score" for m in models]
    scores = min_max(materialise(scores, "scores"), names)
    mean = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
    scores = materialise(scores.withColumn("ensemble_score", mean), "ensemble")
    return hybrid(label(scores, contamination=contamination))


def hybrid(scores: DataFrame) -> DataFrame:
    mixed = F.col("ensemble_score") * ENSEMBLE_WEIGHT + F.col("distance_score") * DISTANCE_WEIGHT
    return scores.withColumn("hybrid_score", mixed).withColumn("severity", severity(F.col("hybrid_score")))


def anomaly_totals(scored: DataFrame) -> DataFrame:
    """Flagged rows, their share, and severities among the flagged."""
    flagged, n = F.col("label") == 1, F.count(F.lit(1))
    found = F.count_if(flagged)
    return scored.agg(found.alias("anomaly_count"), F.round(found / n * 100, 2).alias("anomaly_rate"),
                      *[F.count_if(flagged & (F.col("severity") == s)).alias(s) for s in ("high", "medium", "low")])


def top_anomalies(scored: DataFrame, key: str, limit: int = 10) -> DataFrame:
    return scored.filter(F.col("label") == 1).orderBy(F.col("hybrid_score").desc(), key).limit(limit)


def driving_features(encoded: DataFrame, key: str, features: list[str], chosen: DataFrame,
                     low: float = 5.0, high: float = 95.0) -> DataFrame:
    """``(key, feature, percentile)`` of the ``chosen`` rows (a top list) where a value lies in a tail.

    The percentile is the share of non-null values strictly below. Codes of texts follow text order, so they rank
    like the texts themselves. All chosen values are counted in one pass of conditional sums.
    """
    rows = encoded.join(F.broadcast(chosen.select(key)), key, "left_semi").select(key, *features).collect()
    cells = [(r[key], c, r[c]) for r in rows for c in features if r[c] is not None]
    out_type = f"`{key}` {encoded.schema[key].dataType.simpleString()}, feature string, percentile double"
    if not cells:
        return encoded.sparkSession.createDataFrame([], out_type)
    distinct = sorted({(c, v) for _, c, v in cells})
    below = {}
    step = 40
    for start in range(0, len(distinct), step):
        part = distinct[start:start + step]
        row = encoded.agg(*[F.count_if(F.col(c) < v).alias(f"b{i}") for i, (c, v) in enumerate(part)]).first()
        below.update({cv: row[f"b{i}"] for i, cv in enumerate(part)})
    counts = encoded.agg(*[F.count(c).alias(c) for c in features]).first()
    found = [(k, c, 100.0 * below[(c, v)] / counts[c]) for k, c, v in cells]
    return encoded.sparkSession.createDataFrame(
        [(k, c, p) for k, c, p in found if p > high or p < low], out_type)
