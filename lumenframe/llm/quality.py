"""Quality scores: random Fourier features of document statistics, ridge from summed normal equations, isotonic scale.

The features approximate a Gaussian kernel over a fixed set of statistics of the whole text. Every partition of
labelled rows sums its part of the normal equations; the sums meet by row of the matrix, in two rounds, and the driver solves
a system whose size is the number of features. Raw scores of the rows set aside for calibration are summed per score bin and
made monotone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lumenframe.llm.common import column, packed, unpacked, whole_text
from lumenframe.session import materialise

FEATURES = 256
GAMMA = 0.05
RIDGE = 1e-3
CLIP = 4.0
SEED = 20_240_511
BINS = 2_048
ACCEPT = 0.7
STATISTICS = 20
#: Labelled rows per task of the normal equations, so that their sums are far smaller than the rows they come from.
ROWS_PER_SUM = 20_000

#: UTF-8 bytes by kind: upper, lower, digit, space, sentence marks, other ASCII marks, exclamation, bar, other bytes.
_KIND = np.full(256, 8, dtype=np.intp)
_KIND[33:128] = 5
for _chars, _kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), ("abcdefghijklmnopqrstuvwxyz", 1), ("0123456789", 2),
                      (" \t\n\r\x0b\x0c", 3), (".,;:?'\"()-", 4), ("!", 6), ("|", 7)):
    for _c in _chars:
        _KIND[ord(_c)] = _kind


def text_statistics(text: str) -> list[float]:
    """Statistics of a whole text; an empty text has zeros."""
    raw = text.encode("utf-8")
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=9)
    solid = n - kinds[3]
    shares = [kinds[k] / solid for k in (0, 2, 4, 5, 6, 7, 8)]
    p = counts[counts > 0] / n
    distinct = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=m)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, words))
    marked = sum(k for w, k in distinct.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:?"))
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 1
    return [np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), *shares, kinds[3] / n, -float((p * np.log(p)).sum()),
            len(distinct) / m, max(distinct.values()) / m, pairs / max(1, m - 1), upper / m, marked / m,
            np.log1p(m / len(lines)), len(set(lines)) / len(lines)]


@F.pandas_udf(ArrayType(DoubleType()))
def statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([text_statistics(t) for t in texts])


@dataclass
class QualityModel:
    """All that is needed to score a text. ``weights`` is None without labels: then every text scores 1."""

    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(scale=np.sqrt(2 * GAMMA), size=(STATISTICS, FEATURES))
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        scaled = np.clip((stats - self.centre) / self.spread, -CLIP, CLIP)
        return np.c_[np.sqrt(2 / FEATURES) * np.cos(scaled @ directions + phases), np.ones(len(stats))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(stats))
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def _sums(model: QualityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        seen = False
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows = batch.iloc[at:at + 4096]
                z = model.features(np.stack(rows["stats"].to_numpy()))
                total += z.T @ np.c_[z, rows["label"].to_numpy()]
                seen = True
        if seen:
            yield pd.DataFrame({"i": np.arange(FEATURES + 1), "sums": list(total)})
    return run


def _add_rows(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [key[0]], "sums": [np.sum(np.stack(frames["sums"].to_numpy()), axis=0)]})


def summed_equations(model: QualityModel, rows: DataFrame, rows_per_sum: int = ROWS_PER_SUM) -> np.ndarray:
    """The normal equations of ``rows``: stats, label.

    So many rows are summed by one task that the sums don't grow with the number of partitions; of n tasks' sums about the
    square root of n meet at once.
    """
    tasks = max(1, -(-rows.count() // rows_per_sum))
    parts = rows.coalesce(tasks).mapInPandas(_sums(model), "i long, sums array<double>")
    if tasks > 4:
        group = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))
        parts = parts.withColumn("part", group).groupBy("i", "part").applyInPandas(_add_rows, "i long, sums array<double>")
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in parts.groupBy("i").applyInPandas(_add_rows, "i long, sums array<double>").collect():
        system[r["i"]] = r["sums"]
    return system


def _binned(model: QualityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = model.raw(np.stack(batch["stats"].to_numpy()))
                bins = np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)
                yield pd.DataFrame({"bin": bins, "raw": raw, "label": batch["label"].to_numpy()})
    return run


def monotone(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: the ends of each pool and its level."""
    pools: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        pools.append([xi, xi, yi * ni, ni])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    at = np.array([v for p in pools for v in ((p[0], p[1]) if p[1] > p[0] else (p[0],))])
    level = np.array([v for p in pools for v in ([p[2] / p[3]] * (2 if p[1] > p[0] else 1))])
    return at, level


def fit(rows: DataFrame) -> QualityModel:
    """``rows``: stats, label (0 to 1), calibrate (boolean). Fit on the rows that are not for calibration.

    What comes to the driver are sums of fixed size: moments, the normal equations, and one row per score bin.
    """
    rows = rows.persist()
    try:
        moments = rows.filter(~F.col("calibrate")).select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(
            F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).orderBy("i").collect()
        if not moments:
            return QualityModel()
        model = QualityModel(np.array([r["mean"] for r in moments]),
                             np.maximum(np.array([r["sd"] for r in moments]), 1e-6))
        system = summed_equations(model, rows.filter(~F.col("calibrate")))
        n = system[-1, FEATURES]
        penalty = np.eye(FEATURES + 1) * RIDGE * n / FEATURES
        penalty[-1, -1] = 1e-9
        model.weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
        bins = (rows.filter("calibrate").mapInPandas(_binned(model), "bin long, raw double, label double")
                .groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"),
                                    F.count(F.lit(1)).alias("n")).orderBy("bin").collect())
        if bins:
            model.edges, model.levels = monotone(*(np.array([float(r[c]) for r in bins]) for c in ("raw", "label", "n")))
        else:
            model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    finally:
        rows.unpersist()


def fold(id: str) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column(id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _statistics_table(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(column(id).alias("id"), fold(id).alias("fold"), statistics(whole_text(text)).alias("stats"))


def labelled_statistics(table: DataFrame, labels: DataFrame, id: str, label: str, held_out: int = 2,
                        calibrate: int = 3) -> DataFrame:
    """``table``: id, fold, stats. Statistics and labels of the rows that may be learnt from. Repeated labels of an id are
    averaged. The join moves statistics, never texts."""
    known = (labels.select(column(id).alias("id"), column(label).cast("double").alias("label"))
             .filter(F.col("label").isNotNull()).groupBy("id").agg(F.avg("label").alias("label")))
    return (table.filter(F.col("fold") != held_out).join(known, "id")
            .select("stats", "label", (F.col("fold") == calibrate).alias("calibrate")))


def statistics_scorer(model: QualityModel):
    @F.pandas_udf(DoubleType())
    def score(stats: pd.Series) -> pd.Series:
        if not len(stats):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack(stats.to_numpy())))
    return score


def score_documents(df: DataFrame, id: str, text: str, labels: DataFrame, label: str = "quality",
                    accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``df``: id, held_out, score, predicted.

    Only texts feed the score. Rows of fold 2 are never learnt from, those of fold 3 set the scale. Null texts are
    empty; empty texts get the score of their statistics (zeros). Without labels every text scores 1. Repeated rows
    get the same score; an empty table gives an empty result. Texts are read once: their statistics are written.
    """
    table = materialise(_statistics_table(df, id, text), "text-statistics")
    score = statistics_scorer(fit(labelled_statistics(table, labels, id, label)))
    scored = table.select(F.col("id").alias(id), (F.col("fold") == 2).alias("held_out"), score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(df: DataFrame, id: str, text: str, labels: DataFrame, label: str = "quality",
             accept: float = ACCEPT) -> DataFrame:
    """The rows of ``df`` that score at least ``accept``. The rows are written with their statistics, so that each text is
    read once; the fit reads the statistics alone."""
    rows = materialise(df.select(packed(df), column(id).alias("id"), fold(id).alias("fold"),
                                 statistics(whole_text(text)).alias("stats")), "quality-rows")
    score = statistics_scorer(fit(labelled_statistics(rows.select("id", "fold", "stats"), labels, id, label)))
    return unpacked(rows.filter(score("stats") >= accept))
