"""Trees over binned columns: leaf-wise and depth-wise second-order boosting, and forests.

Every column is cut once into at most 255 bins. Rows that agree in all bins and in the label can't be told apart by any
later step, so they become one cell with a weight; how many cells there are depends on the bins and not on the rows. Cells
that fit a checked size are trained on inside tasks, one per model, fold or block of trees, so that a search runs its models
side by side. Beyond that size ``SparkCells`` sums the same histograms of gradients on the executors, for all nodes that can
be asked for at once, and only histograms reach the driver.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumenframe.session import materialise

BINS = 255
#: Bytes of bins of the cells that one task may train on.
CELL_BYTES = 64 << 20
#: Forests are cut into blocks of so many trees, each a task of its own.
FOREST_BLOCK = 50
#: Sums of a level of a tree that are looked at at once.
LEVEL_NUMBERS = 1 << 18
#: A stored table of margins is made anew after so many trees of a training on ``SparkCells``.
REFRESH = 20


# Bins ----------------------------------------------------------------------------------------------------------

def bin_edges(rows: DataFrame, keys: list[str] = (), features: str = "f", bins: int = BINS) -> dict:
    """``{key values: [upper edges per column]}`` of the arrays in ``features``, per group of ``keys``.

    Edges are values that occur, at equal steps of rank; a value belongs to the first bin whose edge is not below it, and
    the last bin has no edge. What returns is bounded by groups, columns and bins.
    """
    steps = [i / bins for i in range(1, bins)]
    found = (rows.select(*keys, F.posexplode(features).alias("i", "v")).groupBy(*keys, "i")
             .agg(F.array_distinct(F.percentile_approx("v", steps, 10_000)).alias("edges"), F.max("v").alias("most"))
             .withColumn("edges", F.filter("edges", lambda e: e < F.col("most"))).collect())
    out: dict = {}
    for r in sorted(found, key=lambda r: r["i"]):
        out.setdefault(tuple(r[k] for k in keys), []).append(np.array(sorted(r["edges"]), dtype=float))
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(edges)], axis=1) \
        if edges else np.zeros((len(x), 0), np.uint8)


def cells(rows: DataFrame, keys: list[str], edges: dict, features: str = "f") -> DataFrame:
    """``keys``, label, bins (one byte per column) and n: the rows that agree in all of these. ``rows`` has ``label``; the
    first keys are those of ``edges``."""
    width = len(next(iter(edges))) if edges else 0
    names = [*keys, "label"]
    schema = T.StructType([*[rows.schema[k] for k in names], T.StructField("bins", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            group = list(zip(*[batch[k] for k in keys[:width]])) if width else [()] * len(batch)
            out = np.empty(len(batch), dtype=object)
            x = batch[features].to_numpy()
            for g in set(group):  # rows of two groups may differ in length
                own = np.flatnonzero([k == g for k in group])
                for at, row in zip(own, to_bins(np.stack(x[own]), edges[g])):
                    out[at] = row.tobytes()
            yield batch[names].assign(bins=out)

    return (rows.select(*names, features).mapInPandas(run, schema).groupBy(*names, "bins")
            .agg(F.count(F.lit(1)).alias("n")))


class Cells:
    """Cells in memory: bins, labels (places of classes), weights; ``offsets`` number the bins of all columns in a row."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, widths: list[int]):
        self.bins, self.label, self.weight, self.widths = bins, label.astype(np.int64), weight.astype(float), widths
        self.offsets = np.r_[0, np.cumsum(widths)].astype(np.int64)
        self.total = int(self.offsets[-1])

    @cached_property
    def flat(self) -> np.ndarray:
        return self.bins.astype(np.int64) + self.offsets[:-1]

    def histogram(self, rows: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Sums of ``stats`` (row by statistic) over all bins of all columns."""
        return self.histograms(rows, stats, np.zeros(len(rows), dtype=np.int64), 1)[0]

    def histograms(self, rows: np.ndarray, stats: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
        """The same for many nodes at once; ``node`` holds the node of each of ``rows``."""
        at, d = self.flat[rows], len(self.widths)
        if nodes > 1:
            at += (node * self.total)[:, None]
        at = at.ravel()
        return np.stack([np.bincount(at, weights=np.repeat(s, d), minlength=nodes * self.total).reshape(nodes, self.total)
                         for s in stats[rows].T], axis=1)


# Splits --------------------------------------------------------------------------------------------------------

def left_sums(histogram: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per bin the sums of its column up to it; the last axis is that of the bins."""
    sums = np.cumsum(histogram, axis=-1)
    starts = np.concatenate([np.zeros_like(sums[..., :1]), sums], axis=-1)[..., offsets[:-1]]
    return sums - np.repeat(starts, np.diff(offsets), axis=-1)


def gain(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g * g / np.maximum(h + penalty, 1e-300)


def best_split(histogram: np.ndarray, offsets: np.ndarray, penalty: float, least_rows: float,
               least_hess: float) -> tuple[float, int, int] | None:
    """Gain, column and bin of the best cut of one node by its histogram of gradient, hessian and weight. Ties go to the
    lower column and bin."""
    value, column, cut = best_splits(histogram[None], offsets, penalty, least_rows, least_hess)
    return (float(value[0]), int(column[0]), int(cut[0])) if column[0] >= 0 else None


def best_splits(histograms: np.ndarray, offsets: np.ndarray, penalty: float, least_rows: float,
                least_hess: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many nodes; the column of a node without a cut is -1. The first column's sums give a node's totals."""
    left = left_sums(histograms, offsets)
    total = histograms[..., offsets[0]:offsets[1]].sum(axis=-1)
    right = total[..., None] - left
    use = (np.minimum(left[:, 2], right[:, 2]) >= least_rows) & (np.minimum(left[:, 1], right[:, 1]) >= least_hess)
    use[:, offsets[1:] - 1] = False
    gains = np.where(use, gain(left[:, 0], left[:, 1], penalty) + gain(right[:, 0], right[:, 1], penalty), -np.inf)
    at = gains.argmax(axis=1)
    value = gains[np.arange(len(at)), at] - gain(total[:, 0], total[:, 1], penalty)
    column = np.searchsorted(offsets, at, side="right") - 1
    return value, np.where(value > 1e-12, column, -1), at - offsets[column]


class Tree:
    """Nodes as arrays. A leaf has column -1."""

    def __init__(self):
        self.column, self.bin, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value) -> int:
        for part, x in ((self.column, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, value)):
            part.append(x)
        return len(self.column) - 1

    def split(self, node: int, column: int, cut: int, left, right) -> tuple[int, int]:
        self.column[node], self.bin[node] = column, cut
        self.left[node], self.right[node] = self.add(left), self.add(right)
        return self.left[node], self.right[node]

    def frozen(self) -> dict:
        return {"column": np.array(self.column, dtype=np.int64), "bin": np.array(self.bin, dtype=np.int64),
                "left": np.array(self.left, dtype=np.int64), "right": np.array(self.right, dtype=np.int64),
                "value": np.array(self.value, dtype=float)}


class Levels:
    """A tree that grows by whole levels. A leaf has column -1."""

    def __init__(self, root: np.ndarray):
        self.parts, self.size = [], 0
        self._add(root)

    def _add(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self.parts.append({"column": np.full(n, -1), "bin": np.zeros(n, np.int64), "left": np.full(n, -1),
                           "right": np.full(n, -1), "value": values})
        self.size += n
        return np.arange(self.size - n, self.size)

    def split(self, nodes: np.ndarray, column: np.ndarray, cut: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Cuts nodes of the last level; returns the new nodes, of each the left and the right one, which have ``values``."""
        last, first = self.parts[-1], self.size - len(self.parts[-1]["column"])
        new = self._add(values)
        for name, x in (("column", column), ("bin", cut), ("left", new[::2]), ("right", new[1::2])):
            last[name][nodes - first] = x
        return new

    def frozen(self) -> dict:
        return {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}


def leaves_of(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The leaf that each row of ``bins`` reaches."""
    at = np.zeros(len(bins), dtype=np.int64)
    open_ = np.flatnonzero(tree["column"][at] >= 0)
    while len(open_):
        node = at[open_]
        low = bins[open_, tree["column"][node]] <= tree["bin"][node]
        at[open_] = np.where(low, tree["left"][node], tree["right"][node])
        open_ = open_[tree["column"][at[open_]] >= 0]
    return at


# Boosting ------------------------------------------------------------------------------------------------------

def boosting_params(params: dict) -> dict:
    """What the two boosters differ in. Leaf-wise: at most 31 leaves of 20 rows or more, the best leaf first. Depth-wise:
    all nodes to a depth, a penalty of 1 on squared leaf values, a hessian of 1 or more per leaf."""
    if str(params["model_name"]).lower() == "lightgbm":
        return {"trees": int(params["lgbm_n_estimators"]), "rate": float(params["lgbm_learning_rate"]), "leaves": 31,
                "depth": 64, "penalty": 0.0, "least_rows": 20.0, "least_hess": 1e-3, "leafwise": True}
    return {"trees": int(params["xgb_n_estimators"]), "rate": float(params["xgb_learning_rate"]), "leaves": 1 << 30,
            "depth": int(params["xgb_max_depth"]), "penalty": 1.0, "least_rows": 0.0, "least_hess": 1.0, "leafwise": False}


def start_margins(totals: np.ndarray) -> np.ndarray:
    """Margins before the first tree from the weight of each class: log odds for two classes, log shares for more."""
    share = np.maximum(totals / max(totals.sum(), 1e-300), 1e-15)
    return np.array([math.log(share[1] / share[0])]) if len(totals) == 2 else np.log(share)


def derivatives(margin: np.ndarray, label: np.ndarray, k: int, classes: int, leafwise: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss for the k-th margin."""
    if classes == 2:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        return p - (label == 1), p * (1 - p)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e[:, k] / e.sum(axis=1)
    return p - (label == k), p * (1 - p) * (classes / (classes - 1) if leafwise else 2.0)


def grow(histograms: Callable[[dict], dict], offsets: np.ndarray, p: dict, eager: bool) -> tuple[dict, dict]:
    """One tree, and its leaves by their paths. ``histograms`` gives for nodes, each with its path of (column, bin, goes left), the sums of gradient,
    hessian and weight; ``eager`` asks for the children of all leaves that may be split, for providers that pay per call."""
    def leaf(h: np.ndarray) -> float:
        g, hess = h[:2, offsets[0]:offsets[1]].sum(axis=1)
        return -p["rate"] * float(g) / max(float(hess) + p["penalty"], 1e-300)

    tree, order = Tree(), 0
    root = histograms({0: ()})[0]
    tree.add(leaf(root))
    known, ends = {(): root}, {(): 0}
    queue: list[tuple] = []

    def offer(node: int, path: tuple) -> None:
        nonlocal order
        if len(path) < p["depth"] and (found := best_split(known[path], offsets, p["penalty"], p["least_rows"], p["least_hess"])):
            heapq.heappush(queue, ((-found[0] if p["leafwise"] else len(path)), order, node, path, found[1], found[2]))
            order += 1

    offer(0, ())
    leaves = 1
    while queue and leaves < p["leaves"]:
        _, _, node, path, column, cut = heapq.heappop(queue)
        left, right = (*path, (column, cut, True)), (*path, (column, cut, False))
        if left not in known:
            asked = [(path, left)]
            if eager:
                asked += [(q[3], (*q[3], (q[4], q[5], True))) for q in queue if (*q[3], (q[4], q[5], True)) not in known]
            found = histograms({i: child for i, (_, child) in enumerate(asked)})
            for i, (parent, child) in enumerate(asked):
                known[child] = found[i]
                known[(*parent, (*child[-1][:2], False))] = known[parent] - found[i]  # the sibling has the rest
        a, b = tree.split(node, column, cut, leaf(known[left]), leaf(known[right]))
        leaves += 1
        offer(a, left)
        offer(b, right)
        del known[path], ends[path]
        ends[left], ends[right] = a, b
    return tree.frozen(), ends


def grow_levels(learnt: Cells, bins: np.ndarray, stats: np.ndarray, p: dict) -> tuple[dict, np.ndarray]:
    """The depth-wise tree that ``grow`` gives, level by level, and the leaf of each row of ``bins``: those of ``learnt``,
    which have ``stats`` (gradient, hessian and weight), and behind them others that only go down."""
    def values(h: np.ndarray) -> np.ndarray:
        sums = h[:, :2, :learnt.offsets[1]].sum(axis=-1)
        return -p["rate"] * sums[:, 0] / np.maximum(sums[:, 1] + p["penalty"], 1e-300)

    here, at, n = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64), len(stats)  # rows that may move, their place
    histograms = learnt.histograms(here[:n], stats, at[:n], 1)
    tree, leaf, active = Levels(values(histograms)), np.zeros(len(here), dtype=np.int64), np.array([0])
    for _ in range(p["depth"]):
        step = max(1, LEVEL_NUMBERS // learnt.total)
        parts = [best_splits(histograms[i:i + step], learnt.offsets, p["penalty"], p["least_rows"], p["least_hess"])[1:]
                 for i in range(0, len(active), step)]
        column, cut = (np.concatenate(x) for x in zip(*parts))
        some = np.flatnonzero(column >= 0)
        if not len(some):
            break
        part = np.full(len(active), -1, dtype=np.int64)
        part[some] = np.arange(len(some))
        stay = part[at] >= 0
        here, at = here[stay], at[stay]
        low = bins[here, column[at]] <= cut[at]
        at = part[at]
        own = low & (here < n)
        left = learnt.histograms(here[own], stats, at[own], len(some))
        histograms = np.stack([left, histograms[some] - left], axis=1).reshape(-1, *left.shape[1:])  # the sibling has the rest
        active = tree.split(active[some], column[some], cut[some], values(histograms))
        at = 2 * at + ~low
        leaf[here] = active[at]
    return tree.frozen(), leaf


def goes(path: tuple, bins: np.ndarray) -> np.ndarray:
    """Which rows follow a path."""
    here = np.ones(len(bins), dtype=bool)
    for column, cut, low in path:
        here &= (bins[:, column] <= cut) == low
    return here


def boost(cells_: Cells, classes: int, params: dict, held: np.ndarray | None = None) -> tuple[list[list[dict]], np.ndarray, np.ndarray]:
    """Trees by round and margin, start margins, and margins of the rows of bins in ``held``."""
    p = boosting_params(params)
    totals = np.bincount(cells_.label, weights=cells_.weight, minlength=classes)[:classes]
    start = start_margins(totals)
    learnt = len(cells_.label)
    bins = cells_.bins if held is None else np.concatenate([cells_.bins, held])
    margin = np.tile(start, (len(bins), 1))
    rounds = []
    for _ in range(p["trees"]):
        trees, steps = [], []
        for k in range(len(start)):
            g, h = derivatives(margin[:learnt], cells_.label, k, classes, p["leafwise"])
            stats = np.stack([g * cells_.weight, h * cells_.weight, cells_.weight], axis=1)
            tree, leaf = (_grow_leaves if p["leafwise"] else grow_levels)(cells_, bins, stats, p)
            trees.append(tree)
            steps.append(tree["value"][leaf])
        for k, step in enumerate(steps):
            margin[:, k] += step
        rounds.append(trees)
        if all(len(t["column"]) == 1 and abs(t["value"][0]) < 1e-15 for t in trees):
            break  # nothing left to learn: all later trees would be the same
    return rounds, start, margin[learnt:]


def _grow_leaves(learnt: Cells, bins: np.ndarray, stats: np.ndarray, p: dict) -> tuple[dict, np.ndarray]:
    """A leaf-wise tree, and the leaf of each row as in ``grow_levels``."""
    rows = {(): np.arange(len(bins))}

    def histograms(nodes: dict) -> dict:
        found = {}
        for i, path in nodes.items():
            if path and path not in rows:
                own = rows[path[:-1]]
                low = bins[own, path[-1][0]] <= path[-1][1]
                rows[path], rows[(*path[:-1], (*path[-1][:2], False))] = own[low], own[~low]
            found[i] = learnt.histogram(rows[path][:np.searchsorted(rows[path], len(stats))], stats)
        return found

    tree, ends = grow(histograms, learnt.offsets, p, eager=False)
    leaf = np.zeros(len(bins), dtype=np.int64)
    for path, node in ends.items():
        leaf[rows[path]] = node
    return tree, leaf


# Forests -------------------------------------------------------------------------------------------------------

def forest_tree(cells_: Cells, classes: int, depth: int, rng: np.random.Generator) -> dict:
    """A tree on a bootstrap sample, level by level: at each node the best Gini cut among the square root of the columns.

    A cell of weight n is drawn as often as a Poisson number of mean n, which is the bootstrap for rows that can't be told
    apart. Values are class shares.
    """
    drawn = rng.poisson(cells_.weight).astype(float)
    rows = np.flatnonzero(drawn)
    if not len(rows):
        rows, drawn = np.arange(len(drawn)), cells_.weight
    d = cells_.bins.shape[1]
    tried = max(1, int(math.sqrt(d)))
    label, weight, bins = cells_.label[rows], drawn[rows], cells_.bins[rows]
    level = np.bincount(label, weights=weight, minlength=classes)[:classes][None]  # class weights of the last nodes
    tree = Levels(level / level.sum(axis=1, keepdims=True))
    node, active = np.zeros(len(rows), dtype=np.int64), np.array([0])
    here = np.arange(len(rows))
    for _ in range(depth):
        whole = level
        weight_of = whole.sum(axis=1)
        pure = (whole ** 2).sum(axis=1) / weight_of
        chosen = np.argsort(rng.random((len(active), d)), axis=1) < tried
        mixed = np.flatnonzero(pure < weight_of - 1e-9)  # places in ``active`` of nodes with more than one class
        if not len(mixed):
            break
        place = np.full(tree.size, -1, dtype=np.int64)
        place[active[mixed]] = np.arange(len(mixed))
        here = here[place[node[here]] >= 0]
        at = place[node[here]]
        whole, columns = whole[mixed], np.nonzero(chosen[mixed])[1].reshape(len(mixed), tried)
        column, cut, left = gini_cuts(bins[here], label[here], weight[here], at, whole, columns, cells_.widths)
        lost = np.flatnonzero(column < 0)
        if len(lost):  # none of the drawn columns can cut these: any cut of any column
            column[lost], cut[lost] = random_cuts(bins, here, at, lost, len(mixed), rng)
            of = np.full(len(mixed), -1, dtype=np.int64)
            of[lost[column[lost] >= 0]] = np.flatnonzero(column[lost] >= 0)
            own = here[of[at] >= 0]
            to = of[place[node[own]]]
            low = bins[own, column[lost][to]] <= cut[lost][to]
            left[lost] = np.bincount(to[low] * classes + label[own[low]], weights=weight[own[low]],
                                     minlength=len(lost) * classes).reshape(-1, classes)
        some = np.flatnonzero(column >= 0)
        if not len(some):
            break
        level = np.stack([left[some], whole[some] - left[some]], axis=1).reshape(-1, classes)
        active = tree.split(active[mixed[some]], column[some], cut[some], level / level.sum(axis=1, keepdims=True))
        part = np.full(len(mixed), -1, dtype=np.int64)
        part[some] = np.arange(len(some))
        here, at = here[part[at] >= 0], at[part[at] >= 0]
        low = bins[here, column[at]] <= cut[at]
        node[here] = active[2 * part[at] + np.where(low, 0, 1)]
    return tree.frozen()


def gini_cuts(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, at: np.ndarray, whole: np.ndarray,
              columns: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the best Gini cut among its ``columns`` (rising): column, bin and class weights on the left; column -1
    where none of them varies. ``at``: the node of each row; ``whole``: class weights by node. Ties go to the lower column
    and bin. Only bins that occur are looked at, as a cut at another one is that of the bin before it."""
    nodes, classes = whole.shape
    wide = np.asarray(widths, dtype=np.int64)[columns]
    begin = (np.cumsum(wide) - wide.ravel()).reshape(wide.shape)
    spot = (begin[at] + np.take_along_axis(bins, columns[at], axis=1)).ravel()
    size = int(wide.sum())
    held = np.bincount(spot, minlength=size)
    seen = np.flatnonzero(held)
    rank = np.zeros(size, dtype=np.int64)
    rank[seen] = np.arange(len(seen))
    spot = rank[spot]
    tries = columns.shape[1]
    sums = np.stack([np.bincount(spot, weights=np.repeat(np.where(label == c, weight, 0.0), tries), minlength=len(seen))
                     for c in range(classes)])
    group = np.searchsorted(begin.ravel(), seen, side="right") - 1  # node and column of each occurring bin
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    left = np.cumsum(sums, axis=1)
    before = np.concatenate([np.zeros((classes, 1)), left], axis=1)[:, start]
    left -= np.repeat(before, np.diff(np.r_[start, len(seen)]), axis=1)
    of = group // tries
    right = whole.T[:, of] - left
    nl, nr = left.sum(axis=0), right.sum(axis=0)
    score = (left ** 2).sum(axis=0) / np.maximum(nl, 1e-300) + (right ** 2).sum(axis=0) / np.maximum(nr, 1e-300)
    score[(nl <= 0) | (nr <= 0)] = -np.inf
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # every node has rows, and so bins
    top = np.maximum.reduceat(score, first)
    hits = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[first, len(seen)])))
    best = hits[np.flatnonzero(np.r_[True, of[hits][1:] != of[hits][:-1]])]
    found = np.isfinite(top)
    column = np.where(found, columns.ravel()[group[best]], -1)
    return column, seen[best] - begin.ravel()[group[best]], np.ascontiguousarray(left[:, best].T)


def random_cuts(bins: np.ndarray, here: np.ndarray, at: np.ndarray, asked: np.ndarray, nodes: int,
                rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For each of the nodes ``asked`` one cut, drawn from all that leave rows on both sides: column (-1 if there is none)
    and bin. ``at``: the node of each row of ``here``."""
    wanted = np.zeros(nodes, dtype=bool)
    wanted[asked] = True
    own = np.flatnonzero(wanted[at])
    own = own[np.argsort(at[own], kind="stable")]
    start = np.flatnonzero(np.r_[True, at[own][1:] != at[own][:-1]])
    mine = bins[here[own]]
    low = np.minimum.reduceat(mine, start, axis=0).astype(np.int64)
    ends = np.cumsum(np.maximum.reduceat(mine, start, axis=0) - low, axis=1)
    drawn = np.array([rng.integers(0, n) if n else -1 for n in ends[:, -1]])
    column = (ends <= drawn[:, None]).sum(axis=1)
    line = np.arange(len(asked))
    cut = low[line, column] + drawn - np.where(column > 0, ends[line, column - 1], 0)
    return np.where(drawn >= 0, column, -1), cut


# Training many models ------------------------------------------------------------------------------------------

def packed_cells(table: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key`` with all its cells, in a fixed order; ``held`` marks those that are only scored."""
    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["held", "label", "bins"], ignore_index=True)
        return pd.DataFrame({key: [group[0]], "bins": [b"".join(frame["bins"])],
                             "label": [frame["label"].to_numpy(np.float64).tobytes()],
                             "n": [frame["n"].to_numpy(np.float64).tobytes()],
                             "held": [frame["held"].to_numpy(bool).tobytes()]})
    schema = f"{key} {table.schema[key].dataType.simpleString()}, bins binary, label binary, n binary, held binary"
    return table.groupBy(key).applyInPandas(run, schema)


def _unpacked(row, widths: list[int]) -> tuple[Cells, Cells]:
    label, n = np.frombuffer(row["label"]), np.frombuffer(row["n"])
    held = np.frombuffer(row["held"], dtype=bool)
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(len(label), len(widths))
    return (Cells(bins[~held], label[~held], n[~held], widths), Cells(bins[held], label[held], n[held], widths))


def fit_cells(train: Cells, held: Cells, params: dict, classes: int, seed: int, first: int = 0,
              trees: int | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Trees (by round), start and scores of the held cells. A forest is fitted from its tree ``first`` on."""
    if params["model_name"] == "random_forest":
        grown, score = [], np.zeros((len(held.label), classes))
        for i in range(first, first + (trees or int(params["rf_n_estimators"]))):
            tree = forest_tree(train, classes, int(params["rf_max_depth"]), np.random.default_rng([seed, i]))
            grown.append([tree])
            score += tree["value"][leaves_of(tree, held.bins)]
        return grown, np.zeros(classes), score
    rounds, start, margin = boost(train, classes, params, held.bins)
    score = np.c_[np.zeros(len(margin)), margin[:, 0]] if classes == 2 else margin
    return rounds, start, score


def blocks(params: dict) -> list[tuple[int, int | None]]:
    """Parts of a model that are fitted apart: blocks of a forest's trees, or all of a booster."""
    if params["model_name"] != "random_forest":
        return [(0, None)]
    n = int(params["rf_n_estimators"])
    return [(i, min(FOREST_BLOCK, n - i)) for i in range(0, n, FOREST_BLOCK)]


def work(params: dict, trees: int | None) -> float:
    """About how long a part of a model takes: its trees times their levels."""
    if params["model_name"] == "random_forest":
        return trees * min(int(params["rf_max_depth"]), 20)
    p = boosting_params(params)
    return p["trees"] * min(p["depth"], 5)


def dealt_parts(packed: DataFrame, key: str, asked: list[tuple[int, object, dict]]) -> DataFrame:
    """The parts of the models, each with the cells of its key in a task of its own: hashes would give one task two parts
    and another none. The longest parts start first."""
    parts = sorted(((m, k, p, a, n) for m, k, p in asked for a, n in blocks(p)), key=lambda x: -work(x[2], x[4]))
    rows = [(m, k, json.dumps(p), a, n, i) for i, (m, k, p, a, n) in enumerate(parts)]
    kind = packed.schema[key].dataType.simpleString()
    todo = packed.sparkSession.createDataFrame(rows, f"model int, {key} {kind}, params string, first int, trees int, task int")
    return todo.join(packed, key).repartitionByRange(max(1, len(rows)), "task")


def score_models(packed: DataFrame, key: str, asked: list[tuple[int, object, dict]], widths: dict, classes: int,
                 seed: int = 42) -> dict:
    """``{(model, key value): (right, all)}`` for models (number, key value, params) fitted on the cells of their key that are
    not held, and tried on those that are. One task per model, or per block of a forest; scores meet by model."""
    joined, kind = dealt_parts(packed, key, asked), packed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                train, held = _unpacked(r, widths[(r[key],)])
                score = fit_cells(train, held, json.loads(r["params"]), classes, seed, int(r["first"]),
                                  None if pd.isna(r["trees"]) else int(r["trees"]))[2]
                yield pd.DataFrame({"model": [r["model"]], key: [r[key]], "score": [score.tobytes()],
                                    "label": [held.label.tobytes()], "n": [held.weight.tobytes()]})

    def total(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        score = sum(np.frombuffer(s).reshape(-1, classes) for s in frame["score"])
        label, n = np.frombuffer(frame["label"].iloc[0], dtype=np.int64), np.frombuffer(frame["n"].iloc[0])
        right = float(n[score.argmax(axis=1) == label].sum()) if len(label) else 0.0
        return pd.DataFrame({"model": [group[0]], key: [group[1]], "hits": [right], "rows": [float(n.sum())]})

    scored = joined.mapInPandas(run, f"model int, {key} {kind}, score binary, label binary, n binary")
    found = scored.groupBy("model", key).applyInPandas(total, f"model int, {key} {kind}, hits double, rows double").collect()
    return {(r["model"], r[key]): (r["hits"], r["rows"]) for r in found}


# Cells beyond one task -----------------------------------------------------------------------------------------

class SparkCells:
    """Cells in a table: histograms are summed by the executors. ``table``: label, bins, n."""

    def __init__(self, table: DataFrame, widths: list[int], classes: int):
        self.table, self.widths, self.classes = table, widths, classes
        self.offsets = np.r_[0, np.cumsum(widths)].astype(np.int64)
        totals = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        self.start = start_margins(np.array([float(totals.get(float(c), 0)) for c in range(classes)]))
        self.margins = table.withColumn("margin", F.array(*[F.lit(float(s)) for s in self.start]))
        self.stored = 0

    def histograms(self, rounds: list[list[dict]], k: int, nodes: dict, leafwise: bool) -> dict:
        """The sums of each node over all bins, for the k-th margin after ``rounds``."""
        recent, widths, offsets, classes = rounds[self.stored:], self.widths, self.offsets, self.classes
        total = int(offsets[-1])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(nodes), 3, total))
            seen = False
            for batch in batches:
                if len(batch):
                    own = Cells(_bins(batch, len(widths)), batch["label"].to_numpy(), batch["n"].to_numpy(), widths)
                    margin = advanced(np.stack(batch["margin"].to_numpy()), own.bins, recent)
                    g, h = derivatives(margin, own.label, k, classes, leafwise)
                    stats = np.stack([g * own.weight, h * own.weight, own.weight], axis=1)
                    for i, path in nodes.items():
                        sums[i] += own.histogram(np.flatnonzero(goes(path, own.bins)), stats)
                    seen = True
            if seen:
                yield pd.DataFrame({"node": list(nodes), "s": [x.ravel() for x in sums]})

        def add(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"node": [group[0]], "s": [np.sum(np.stack(frame["s"].to_numpy()), axis=0)]})

        parts = self.margins.mapInPandas(run, "node long, s array<double>")
        wide = int(self.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(max(2, math.isqrt(wide)))))
        half = some.groupBy("node", "part").applyInPandas(  # in two rounds, so that no task adds one row of every partition
            lambda g, f: add(g, f), "node long, s array<double>")
        found = half.groupBy("node").applyInPandas(add, "node long, s array<double>").collect()
        zero = np.zeros((3, total))
        return {i: zero for i in nodes} | {r["node"]: np.array(r["s"]).reshape(3, total) for r in found}

    def keep(self, rounds: list[list[dict]]) -> None:
        """Write the margins after ``rounds``, so that later jobs start from there."""
        recent, d = rounds[self.stored:], len(self.widths)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    margin = advanced(np.stack(batch["margin"].to_numpy()), _bins(batch, d), recent)
                    batch = batch.assign(margin=list(margin))
                yield batch

        self.margins = materialise(self.margins.mapInPandas(run, self.margins.schema), "margins")
        self.stored = len(rounds)

    def boost(self, params: dict) -> tuple[list[list[dict]], np.ndarray]:
        p = boosting_params(params)
        rounds: list[list[dict]] = []
        for _ in range(p["trees"]):
            rounds.append([grow(lambda nodes, k=k: self.histograms(rounds, k, nodes, p["leafwise"]), self.offsets, p, eager=True)[0]
                           for k in range(len(self.start))])
            if len(rounds) - self.stored >= REFRESH:
                self.keep(rounds)
        return rounds, self.start


def _bins(batch: pd.DataFrame, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"]), dtype=np.uint8).reshape(len(batch), d)


def advanced(margin: np.ndarray, bins: np.ndarray, rounds: list[list[dict]]) -> np.ndarray:
    margin = margin.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margin[:, k] += tree["value"][leaves_of(tree, bins)]
    return margin


# Estimators ----------------------------------------------------------------------------------------------------

class BinnedModel(Model):
    """Trees over binned columns of the ``features`` vector. ``transform`` adds ``prediction``, the place of a class."""

    def __init__(self, params: dict, edges: list[np.ndarray], rounds: list[list[dict]] | StoredTrees, start: np.ndarray,
                 classes: int):
        super().__init__()
        self.params_, self.edges, self.rounds, self.start, self.classes = params, edges, rounds, start, classes

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Margins of the classes (the second alone for two classes), or summed class shares of a forest."""
        bins = to_bins(x, self.edges)
        if self.params_["model_name"] != "random_forest":
            return advanced(np.tile(self.start, (len(x), 1)), bins, self.rounds)
        return sum(t["value"][leaves_of(t, bins)] for trees in self.rounds for t in trees)

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.params_, self.edges, self.rounds, self.start, self.classes))

        @F.pandas_udf(T.DoubleType())
        def predicted(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            model = BinnedModel(*shared.value)
            score = model.scores(np.stack(x.to_numpy()))
            return pd.Series((score[:, 0] > 0 if score.shape[1] == 1 else score.argmax(axis=1)).astype(float))

        return df.withColumn("prediction", predicted(vector_to_array("features")))


class BinnedTrees(Estimator):
    """Second-order boosting (lightgbm: leaf-wise, xgboost: depth-wise) or a random forest on ``features`` and ``label``."""

    def __init__(self, params: dict, classes: int = 2, seed: int = 42, cell_bytes: int = CELL_BYTES):
        super().__init__()
        self.params_, self.classes, self.seed, self.cell_bytes = params, max(2, classes), seed, cell_bytes

    def _fit(self, df: DataFrame) -> BinnedModel:
        rows = df.select(F.lit(0).alias("split"), F.lit(False).alias("held"), "label", vector_to_array("features").alias("f"))
        edges = bin_edges(rows, ["split"]).get((0,), [])
        widths = [len(e) + 1 for e in edges]
        table = materialise(cells(rows, ["split", "held"], {(0,): edges}), "cells")
        if not fits(table, widths, self.cell_bytes):
            if self.params_["model_name"] == "random_forest":
                return _spark_forest(self.params_, self.seed).fit(df)
            rounds, start = SparkCells(table.drop("split", "held"), widths, self.classes).boost(self.params_)
            return BinnedModel(self.params_, edges, rounds, start, self.classes)
        packed = packed_cells(table, "split")
        parts = blocks(self.params_)
        todo = table.sparkSession.createDataFrame([(0, a, n) for a, n in parts], "split int, first int, trees int")
        params, classes, seed = self.params_, self.classes, self.seed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    train, held = _unpacked(r, widths)
                    rounds, start, _ = fit_cells(train, held, params, classes, seed, int(r["first"]),
                                                 None if pd.isna(r["trees"]) else int(r["trees"]))
                    yield pd.DataFrame({"first": [r["first"]], "trees": [[dump_trees(t) for t in rounds]], "start": [start]})

        found = (todo.join(packed, "split").repartition(len(parts), "first")
                 .mapInPandas(run, "first int, trees array<binary>, start array<double>").collect())
        rounds = StoredTrees([bytes(t) for r in sorted(found, key=lambda r: r["first"]) for t in r["trees"]])
        start = np.array(found[0]["start"]) if found else np.zeros(self.classes)
        return BinnedModel(self.params_, edges, rounds, start, self.classes)


class StoredTrees:
    """The trees of each round or place of a forest as a few bytes, unpacked one after the other when they are walked."""

    def __init__(self, data: list[bytes]):
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def __iter__(self) -> Iterator[list[dict]]:
        return map(load_trees, self.data)

    def __getitem__(self, i: int) -> list[dict]:
        return load_trees(self.data[i])


#: What holds the numbers of a node: there are at most 255 bins.
NODE_TYPES = {"column": np.int32, "bin": np.uint8, "left": np.int32, "right": np.int32, "value": np.float64}


def dump_trees(trees: list[dict]) -> bytes:
    """The trees of a round, or of all rounds, as bytes."""
    packed = [[{k: np.asarray(v).astype(NODE_TYPES[k]) for k, v in t.items()} for t in part] if isinstance(part, list) else
              {k: np.asarray(v).astype(NODE_TYPES[k]) for k, v in part.items()} for part in trees]
    return zlib.compress(pickle.dumps(packed, protocol=5), 1)


def load_trees(data: bytes) -> list:
    return pickle.loads(zlib.decompress(data))


def fits(table: DataFrame, widths: list[int], most: int = CELL_BYTES) -> bool:
    """Whether the cells of each split are small enough for a task."""
    largest = table.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return largest * (len(widths) + 16) <= most


def _spark_forest(params: dict, seed: int):
    from pyspark.ml.classification import RandomForestClassifier
    return RandomForestClassifier(numTrees=int(params["rf_n_estimators"]), maxDepth=int(params["rf_max_depth"]), seed=seed)


def importance(rounds: list[list[dict]], columns: int) -> np.ndarray:
    """How many cuts use each column."""
    used = np.zeros(columns, dtype=np.int64)
    for trees in rounds:
        for t in trees:
            np.add.at(used, t["column"][t["column"] >= 0], 1)
    return used
