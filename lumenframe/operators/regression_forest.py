"""Random forests for regression over binned rows.

Rows that agree in all bins can't be told apart by any cut, so a tree needs only their drawn number and the drawn sum of their
labels. One pass over the rows draws the bootstrap sample of every row for a block of trees and sums it by cell; each tree is
then grown on its cells in a task of its own. The passes do not depend on the depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from lumenframe.operators.boosting import BINS, bin_edges, left_sums, to_bins
from lumenframe.operators.extra_trees import ExtraTreesModel

#: Cells beyond which trees are grown by Spark.
MOST_CELLS = 1 << 18
#: Sums that a task holds at once while it draws (8 bytes each), and the cells of a piece of them.
SUMS, PIECE = 1 << 23, 1 << 12
#: Rows that a task sorts by cell at once, and those that it draws for at once: a number of 16 bits picks one of them.
CHUNK, BLOCK = 1 << 19, 1 << 16
NODE = ("feature", "cut", "left", "right", "cover", "value")


def met_rows(rows: DataFrame, columns: list[str], most: int) -> tuple[list[np.ndarray], np.ndarray] | None:
    """The distinct rows of ``columns``, column by column, and how often each occurs; none if they are more than ``most``, which
    a sketch tells before any meet."""
    if rows.agg(F.approx_count_distinct(F.xxhash64(*columns))).first()[0] > most:
        return None
    found = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).toArrow()
    return [found[c].to_numpy() for c in columns], found["n"].to_numpy()


def weighted_edges(values: np.ndarray, weight: np.ndarray, bins: int = BINS) -> np.ndarray:
    """``bin_edges`` of a column whose values occur ``weight`` times."""
    found, place = np.unique(values, return_inverse=True)
    upto = np.cumsum(np.bincount(place, weights=weight))
    at = np.unique(np.searchsorted(upto, np.arange(1, bins) / bins * upto[-1], side="left"))
    return found[at[at < len(found) - 1]]


def cell_codes(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """The number that stands for the bins of a row."""
    return to_bins(np.stack(columns, axis=1), edges).astype(np.int64) @ np.r_[1, np.cumprod([len(e) + 1 for e in edges])][:-1]


def met_codes(rows: DataFrame, columns: list[str], edges: list[np.ndarray], most: int) -> np.ndarray:
    """The codes that occur, or ``most`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = np.unique(cell_codes([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], edges))
                yield pa.RecordBatch.from_arrays([pa.array(own)], ["code"])

    return rows.select(*columns).mapInArrow(run, "code long").distinct().limit(most).toArrow()["code"].to_numpy()


def poisson_numbers(rng: np.random.Generator, rows: int) -> np.ndarray:
    """Poisson numbers of mean 1 for up to ``BLOCK`` rows: a Poisson number of draws of one of ``BLOCK`` places, counted by
    place."""
    draws = int(rng.poisson(BLOCK))
    drawn = rng.integers(0, 1 << 64, -(-draws // 4), dtype=np.uint64).view(np.uint16)[:draws]
    return np.bincount(drawn, minlength=BLOCK)[:rows]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to ``rows`` or some more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def drawn_sums(rows: DataFrame, columns: list[str], edges: list[np.ndarray], codes: np.ndarray, first: int, trees: int,
               seed: int) -> DataFrame:
    """``(tree, piece, n, s)``: rows drawn and the sum of their labels by cell, for trees ``first`` and following. A row is drawn
    a Poisson number of mean 1 of times."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, first, TaskContext.get().partitionId()])
        places = shared.value
        n, s = np.zeros((len(places), trees)), np.zeros((len(places), trees))
        for chunk in _chunks(batches, CHUNK):
            cells = np.searchsorted(places, cell_codes([chunk[c].to_numpy() for c in columns], edges))
            order = np.argsort(cells, kind="stable")
            cells, labels = cells[order], chunk["label"].to_numpy()[order]
            for i in range(0, len(cells), BLOCK):
                cell, y = cells[i:i + BLOCK], labels[i:i + BLOCK]
                starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                own_n, own_s = np.empty((trees, len(starts))), np.empty((trees, len(starts)))
                for t in range(trees):
                    drawn = poisson_numbers(rng, len(cell))
                    own_n[t], own_s[t] = np.add.reduceat(drawn, starts), np.add.reduceat(drawn * y, starts)
                n[cell[starts]] += own_n.T
                s[cell[starts]] += own_s.T
        pieces = range(0, len(places), PIECE)
        for t in range(trees):
            parts = [pa.array([v[i:i + PIECE, t] for i in pieces], pa.list_(pa.float64())) for v in (n, s)]
            yield pa.RecordBatch.from_arrays([pa.array([first + t] * len(pieces), pa.int32()), pa.array(list(pieces), pa.int32()),
                                              *parts], ["tree", "piece", "n", "s"])

    def add(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [group[0]], "piece": [group[1]], "n": [frame["n"].sum()], "s": [frame["s"].sum()]})

    shape = "tree int, piece int, n array<double>, s array<double>"
    return rows.mapInArrow(run, shape).groupBy("tree", "piece").applyInPandas(add, shape)


def grow(bins: np.ndarray, n: np.ndarray, s: np.ndarray, edges: list[np.ndarray], depth: int, rng: np.random.Generator) -> dict:
    """One tree, level by level: at each node the cut of least squares among a third of the columns, drawn from those that
    vary there. Nodes as lists."""
    drawn = n > 0
    bins, n, s = bins[drawn].astype(np.int64), n[drawn], s[drawn]
    widths = [len(e) + 1 for e in edges]
    offsets = np.r_[0, np.cumsum(widths)].astype(np.int64)
    d, total, flat = len(widths), int(offsets[-1]), bins + offsets[:-1]
    tried = max(1, math.ceil(d / 3))
    tree: dict[str, list] = {k: [] for k in NODE}

    def add(cover: float, label: float) -> int:
        for k, v in zip(NODE, (0, 0.0, -1, -1, cover, label / cover)):
            tree[k].append(v)
        return len(tree["left"]) - 1

    add(float(n.sum()), float(s.sum()))
    sums = [float(s.sum())]
    node, active = np.zeros(len(n), dtype=np.int64), np.array([0])
    for _ in range(depth):
        place = np.full(len(sums), -1, dtype=np.int64)
        place[active] = np.arange(len(active))
        here = np.flatnonzero(place[node] >= 0)
        at = ((place[node[here]] * total)[:, None] + flat[here]).ravel()
        both = [np.bincount(at, weights=np.repeat(v[here], d), minlength=len(active) * total).reshape(len(active), total)
                for v in (n, s)]
        left_n, left_s = (left_sums(v, offsets) for v in both)
        all_n, all_s = np.array([tree["cover"][a] for a in active])[:, None], np.array([sums[a] for a in active])[:, None]
        right_n, right_s = all_n - left_n, all_s - left_s
        use = (left_n > 0.5) & (right_n > 0.5)
        varies = np.logical_or.reduceat(use, offsets[:-1], axis=1)
        order = np.argsort(np.argsort(np.where(varies, rng.random((len(active), d)), 2.0), axis=1), axis=1)
        use &= np.repeat(order < tried, widths, axis=1)
        score = np.where(use, left_s ** 2 / np.maximum(left_n, 1) + right_s ** 2 / np.maximum(right_n, 1), -np.inf)
        best = score.argmax(axis=1)
        following = []
        for i, a in enumerate(active):
            j, whole = best[i], float(all_s[i, 0] ** 2 / all_n[i, 0])
            if score[i, j] <= whole + 1e-12 * max(1.0, abs(whole)):
                continue
            column = int(np.searchsorted(offsets, j, side="right") - 1)
            tree["feature"][a], tree["cut"][a] = column, float(edges[column][j - offsets[column]])
            for side, own_n, own_s in (("left", left_n, left_s), ("right", right_n, right_s)):
                tree[side][a] = add(float(own_n[i, j]), float(own_s[i, j]))
                sums.append(float(own_s[i, j]))
                following.append(tree[side][a])
            rows = here[node[here] == a]
            low = bins[rows, column] <= j - offsets[column]
            node[rows] = np.where(low, tree["left"][a], tree["right"][a])
        if not following:
            break
        active = np.array(following)
    return tree


class RegressionForest(Estimator):
    """Bootstrap samples of rows, a third of the columns at every node. Columns that make too many cells are left to Spark."""

    def __init__(self, trees: int = 100, depth: int = 8, seed: int = 42, most_cells: int = MOST_CELLS):
        super().__init__()
        self.trees, self.depth, self.seed, self.most_cells = trees, depth, seed, most_cells

    def _fit(self, df: DataFrame):
        x = vector_to_array("features")
        width = df.select(F.size(x)).first()
        columns = [f"f{i}" for i in range(width[0] if width else 0)]
        rows = df.select(*[F.get(x, F.lit(i)).alias(c) for i, c in enumerate(columns)], F.col("label").cast("double").alias("label"))
        met = met_rows(rows, columns, self.most_cells) if columns else None
        if met:
            edges = [weighted_edges(v, met[1]) for v in met[0]]
        else:
            edges = bin_edges(rows.select(F.array(*columns).alias("f"))).get((), []) if columns else []
        widths = [len(e) + 1 for e in edges]
        codes = None
        if met:
            codes = np.unique(cell_codes(met[0], edges))
        elif edges and math.prod(widths) < 1 << 62:
            codes = met_codes(rows, columns, edges, self.most_cells + 1)
        if codes is None or not 0 < len(codes) <= self.most_cells:
            return RandomForestRegressor(numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(df)
        codes = np.sort(codes)
        bins = np.stack(np.unravel_index(codes, widths[::-1])[::-1], axis=1).astype(np.uint8)
        shared = df.sparkSession.sparkContext.broadcast(bins)
        mean, rows_, depth, seed = *rows.agg(F.avg("label"), F.count("label")).first(), self.depth, self.seed
        trees = []
        step = max(1, SUMS // (2 * len(codes)))

        def whole(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("piece")
            n, s = (np.concatenate(frame[c].to_list()) for c in "ns")
            if not n.any():  # very few rows: none was drawn
                tree = {k: [v] for k, v in zip(NODE, (0, 0.0, -1, -1, float(rows_), mean))}
            else:
                tree = grow(shared.value, n, s, edges, depth, np.random.default_rng([seed, int(group[0])]))
            return pd.DataFrame({"tree": [group[0]], **{k: [tree[k]] for k in NODE}})

        shape = ("tree int, feature array<long>, cut array<double>, left array<long>, right array<long>, cover array<double>, "
                 "value array<double>")
        for first in range(0, self.trees, step):
            sums = drawn_sums(rows, columns, edges, codes, first, min(step, self.trees - first), seed)
            trees += sums.groupBy("tree").applyInPandas(whole, shape).collect()
        arrays = [{k: np.array(r[k]) for k in NODE} for r in sorted(trees, key=lambda r: r["tree"])]
        return ExtraTreesModel([{**a, "classes": np.zeros((len(a["left"]), 0))} for a in arrays], 0)
