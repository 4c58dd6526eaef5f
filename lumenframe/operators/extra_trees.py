"""Extremely randomised trees, grown level by level over the whole table.

At every node of every tree some columns get one cut each, drawn evenly between the least and the largest value of the node's
rows, and the best of these is taken. Rows that agree in all columns become one, with their sums. A level takes two passes over
these, whatever the number of trees: one for the ranges at all nodes, one for the sums left of all drawn cuts. Both are summed by
the executors; what reaches the driver is bounded by the number of nodes and columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from lumenframe.operators.tree_cells import CellValues

LEAST_SPLIT = 2


def walk(tree: dict, x: np.ndarray) -> np.ndarray:
    """The node that each row stops at; a node without cut has ``left`` below 0."""
    at = np.zeros(len(x), dtype=np.int64)
    open_ = np.flatnonzero(tree["left"][at] >= 0)
    while len(open_):
        node = at[open_]
        low = x[open_, tree["feature"][node]] <= tree["cut"][node]
        at[open_] = np.where(low, tree["left"][node], tree["right"][node])
        open_ = open_[tree["left"][at[open_]] >= 0]
    return at


def _empty_tree() -> dict:
    return {"feature": np.zeros(1, np.int64), "cut": np.zeros(1), "left": np.full(1, -1), "right": np.full(1, -1)}


def merged_rows(rows: DataFrame, classes: int) -> DataFrame:
    """``(f, s0, s1...)``: equal rows of ``f`` and ``label`` as one, with what nodes sum: rows, label and its square, or one
    column per class."""
    y = F.col("label")
    sums = [F.count_if(y == i) for i in range(classes)] or [F.count(F.lit(1)), F.sum(y), F.sum(y * y)]
    return rows.groupBy("f").agg(*[x.cast("double").alias(f"s{i}") for i, x in enumerate(sums)])


def _row_sums(batch: pd.DataFrame, classes: int) -> np.ndarray:
    return batch[[f"s{i}" for i in range(classes or 3)]].to_numpy(dtype=float)


def _sorted_groups(node: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows that are in ``nodes``, where a node begins in it, and the nodes found."""
    here = np.flatnonzero(np.isin(node, nodes))
    order = here[np.argsort(node[here], kind="stable")]
    found = node[order]
    start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
    return order, start, found[start]


def node_ranges(rows: DataFrame, forest: list[dict], active: list[np.ndarray], columns: int, classes: int) -> dict:
    """``{(tree, node): (least per column, largest per column, sums)}`` of the active nodes."""
    k = classes or 3
    names = [f"lo{j}" for j in range(columns)] + [f"hi{j}" for j in range(columns)] + [f"s{j}" for j in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["f"].to_numpy())
            sums = _row_sums(batch, classes)
            for t, tree in enumerate(forest):
                order, start, found = _sorted_groups(walk(tree, x), active[t])
                if len(found):
                    parts = [np.minimum.reduceat(x[order], start), np.maximum.reduceat(x[order], start),
                             np.add.reduceat(sums[order], start)]
                    yield pd.DataFrame(np.hstack(parts), columns=names).assign(tree=t, node=found)[["tree", "node", *names]]

    parts = rows.mapInPandas(run, "tree int, node long, " + ", ".join(f"{n} double" for n in names))
    how = {"lo": F.min, "hi": F.max}
    found = parts.groupBy("tree", "node").agg(*[how.get(n[:2], F.sum)(n).alias(n) for n in names]).collect()
    return {(r["tree"], r["node"]): tuple(np.array([r[n] for n in part]) for part in
                                          (names[:columns], names[columns:2 * columns], names[2 * columns:])) for r in found}


def drawn_cuts(tree: int, node: int, low: np.ndarray, high: np.ndarray, tried: int, seed: int) -> list[tuple[int, float]]:
    """One cut for each of ``tried`` columns that vary in the node."""
    rng = np.random.default_rng([seed, tree, node])
    varying = np.flatnonzero(high > low)
    chosen = rng.permutation(varying)[:tried]
    return [(int(j), min(float(rng.uniform(low[j], high[j])), float(np.nextafter(high[j], -np.inf)))) for j in sorted(chosen)]


def left_sums(rows: DataFrame, forest: list[dict], cuts: dict, classes: int) -> dict:
    """``{(tree, node, column): sums of the rows not above the cut}``."""
    k = classes or 3
    by_tree: dict = {}
    for (t, node), own in cuts.items():
        for j, cut in own:
            by_tree.setdefault(t, {}).setdefault(j, {})[node] = cut

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["f"].to_numpy())
            sums = _row_sums(batch, classes)
            for t, columns in by_tree.items():
                node = walk(forest[t], x)
                size = len(forest[t]["left"])
                for j, at in columns.items():
                    cut = np.full(size, -np.inf)
                    cut[list(at)] = list(at.values())
                    low = np.flatnonzero(x[:, j] <= cut[node])
                    if len(low):
                        total = np.stack([np.bincount(node[low], weights=s[low], minlength=size) for s in sums.T], axis=1)
                        found = np.unique(node[low])
                        out = pd.DataFrame(total[found], columns=[f"s{i}" for i in range(k)])
                        out.insert(0, "tree", t)
                        out.insert(1, "node", found)
                        out.insert(2, "col", j)
                        yield out

    schema = "tree int, node long, col int, " + ", ".join(f"s{i} double" for i in range(k))
    found = (rows.mapInPandas(run, schema).groupBy("tree", "node", "col")
             .agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).collect())
    return {(r["tree"], r["node"], r["col"]): np.array([r[f"s{i}"] for i in range(k)]) for r in found}


def split_score(left: np.ndarray, total: np.ndarray, classes: int) -> float:
    """What a cut keeps together: larger is better. Squared sums over sizes, of labels or of class counts."""
    right = total - left
    if classes:
        return float((left ** 2).sum() / left.sum() + (right ** 2).sum() / right.sum())
    return float(left[1] ** 2 / left[0] + right[1] ** 2 / right[0])


def _impure(sums: np.ndarray, classes: int) -> bool:
    if classes:
        return np.count_nonzero(sums) > 1
    return sums[2] / sums[0] - (sums[1] / sums[0]) ** 2 > 1e-12 * max(1.0, (sums[1] / sums[0]) ** 2)


def grow_forest(rows: DataFrame, columns: int, classes: int, trees: int, depth: int, seed: int) -> list[dict]:
    """``rows``: see ``merged_rows``. Trees as arrays, with the sums of every node."""
    forest = [_empty_tree() for _ in range(trees)]
    sums: list[list] = [[None] for _ in range(trees)]
    active = [np.array([0]) for _ in range(trees)]
    tried = max(1, int(columns ** 0.5)) if classes else columns
    for level in range(depth + 1):
        if not any(len(a) for a in active):
            break
        found = node_ranges(rows, forest, active, columns, classes)
        cuts = {}
        for (t, node), (low, high, own) in found.items():
            sums[t][node] = own
            n = own.sum() if classes else own[0]
            if level < depth and n >= LEAST_SPLIT and _impure(own, classes):
                drawn = drawn_cuts(t, node, low, high, tried, seed)
                if drawn:
                    cuts[t, node] = drawn
        if not cuts:
            break
        left = left_sums(rows, forest, cuts, classes)
        following: list[list[int]] = [[] for _ in range(trees)]
        grown: list[dict] = [{k: list(v) for k, v in t.items()} for t in forest]
        for (t, node), drawn in sorted(cuts.items()):
            scored = [(-split_score(left[t, node, j], found[t, node][2], classes), j, cut) for j, cut in drawn]
            _, j, cut = min(scored)
            tree = grown[t]
            tree["feature"][node], tree["cut"][node] = j, cut
            for side in ("left", "right"):
                tree[side][node] = len(tree["left"])
                following[t].append(len(tree["left"]))
                for k, v in (("feature", 0), ("cut", 0.0), ("left", -1), ("right", -1)):
                    tree[k].append(v)
                sums[t].append(None)
        forest = [{"feature": np.array(t["feature"], np.int64), "cut": np.array(t["cut"], float),
                   "left": np.array(t["left"], np.int64), "right": np.array(t["right"], np.int64)} for t in grown]
        active = [np.array(f, dtype=np.int64) for f in following]
    out = []
    for tree, own in zip(forest, sums):
        own = np.array([s if s is not None else np.zeros(classes or 3) for s in own])
        cover = own.sum(axis=1) if classes else own[:, 0]
        value = own.argmax(axis=1).astype(float) if classes else own[:, 1] / np.maximum(cover, 1e-300)
        out.append({**tree, "cover": cover, "value": value, "classes": own if classes else np.zeros((len(cover), 0))})
    return out


class ExtraTreesModel(Model):
    """``transform`` adds ``prediction``: the mean of the trees, or the class with the largest mean share."""

    def __init__(self, node_arrays: list[dict], num_classes: int):
        super().__init__()
        self.node_arrays, self.classes_ = node_arrays, num_classes

    @property
    def numClasses(self) -> int:
        return self.classes_

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.classes_:
            return np.mean([t["value"][walk(t, x)] for t in self.node_arrays], axis=0)
        shares = [t["classes"] / np.maximum(t["classes"].sum(axis=1, keepdims=True), 1e-300) for t in self.node_arrays]
        return sum(s[walk(t, x)] for s, t in zip(shares, self.node_arrays)).argmax(axis=1).astype(float)

    def cuts(self) -> list[np.ndarray]:
        """Per column, up to the last one that is cut, all places at which some tree cuts it."""
        feature, cut = (np.concatenate([t[k][t["left"] >= 0] for t in self.node_arrays]) for k in ("feature", "cut"))
        return [np.unique(cut[feature == j]) for j in range(feature.max(initial=0) + 1)]

    def _transform(self, df: DataFrame) -> DataFrame:
        shared, cuts = df.sparkSession.sparkContext.broadcast((self.node_arrays, self.classes_)), self.cuts()
        ahead = CellValues(cuts, lambda x: ExtraTreesModel(*shared.value).predict(x))  # a copy per task

        @F.arrow_udf(T.DoubleType())
        def predicted(*columns: pa.Array) -> pa.Array:
            return pa.array(ahead(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)))

        x = vector_to_array("features")
        return df.withColumn("prediction", predicted(*[F.get(x, F.lit(j)) for j in range(len(cuts))]))


class ExtraTrees(Estimator):
    """``classes``: 0 for regression. The same seed and rows give the same trees."""

    def __init__(self, classes: int = 0, trees: int = 100, depth: int = 8, seed: int = 42):
        super().__init__()
        self.classes_, self.trees, self.depth, self.seed = classes, trees, depth, seed

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        rows = df.select(vector_to_array("features").alias("f"), F.col("label").cast("double").alias("label"))
        rows = merged_rows(rows, self.classes_).persist()
        try:
            first = rows.first()
            columns = len(first["f"]) if first else 0
            grown = grow_forest(rows, columns, self.classes_, self.trees, self.depth, self.seed)
        finally:
            rows.unpersist()
        return ExtraTreesModel(grown, self.classes_)
