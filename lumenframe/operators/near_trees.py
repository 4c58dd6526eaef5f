"""Approximate distance to the k-th nearest neighbour by trees of random projections, for columns too many for boxes.

Each tree cuts space at medians along random directions into leaves of a few hundred points. The upper cuts come from a bounded
sample and deal the points to groups; a group goes on cutting in memory. A point meets the points of its leaf in every tree, and
what it has found in all of them is merged. The work is points times trees times leaf, whatever the number of columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.operators.neighbours import BLOCK
from lumenframe.session import materialise

TREES = 16
LEAF_ROWS = 512
SAMPLE = 50_000
#: Points a group may hold; leaves of the sample's tree that hold more are cut along one more direction.
GROUP_ROWS = 50_000
#: Sampled points behind each leaf of the upper tree.
SAMPLED_PER_LEAF = 16


def direction(columns: int, rng: np.random.Generator) -> np.ndarray:
    d = rng.normal(size=columns)
    return d / np.linalg.norm(d)


def upper_tree(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (direction, cut, left, right), or (None, leaf, 0, 0)."""
    nodes: list = []
    count = 0

    def node(part: np.ndarray, wanted: int) -> int:
        nonlocal count
        i = len(nodes)
        nodes.append(None)
        d = direction(part.shape[1], rng)
        along = part @ d
        cut = float(np.median(along)) if len(part) else 0.0
        if wanted <= 1 or len(part) < 2 or not (along > cut).any():
            nodes[i] = (None, count, 0, 0)
            count += 1
            return i
        low = along <= cut
        left = node(part[low], wanted // 2)
        nodes[i] = (d, cut, left, node(part[~low], wanted - wanted // 2))
        return i

    node(sample, leaves)
    return nodes


def leaf_of(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    found, waiting = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
    while waiting:
        i, rows = waiting.pop()
        d, cut, left, right = nodes[i]
        if d is None:
            found[rows] = cut
            continue
        low = x[rows] @ d <= cut
        waiting += [(left, rows[low]), (right, rows[~low])]
    return found


def local_leaves(x: np.ndarray, rows: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of the points of each leaf, by medians along random directions."""
    done, waiting = [], [np.arange(len(x))]
    while waiting:
        part = waiting.pop()
        if len(part) <= rows:
            done.append(part)
            continue
        along = x[part] @ direction(x.shape[1], rng)
        half = len(part) // 2
        order = np.argpartition(along, half)
        waiting += [part[order[:half]], part[order[half:]]]
    return done


def nearest_in(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest other points of each point, as far as there are."""
    keep = min(k, len(x) - 1)
    places, distances = np.zeros((len(x), keep), dtype=np.int64), np.zeros((len(x), keep))
    if not keep:
        return places, distances
    lengths = (x * x).sum(axis=1)
    for start in range(0, len(x), BLOCK):
        part = x[start:start + BLOCK]
        square = (part * part).sum(axis=1)[:, None] + lengths[None, :] - 2.0 * (part @ x.T)
        square[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
        best = np.argpartition(square, keep - 1, axis=1)[:, :keep]
        places[start:start + BLOCK] = best
        distances[start:start + BLOCK] = np.sqrt(((part[:, None, :] - x[best]) ** 2).sum(axis=2))
    return places, distances


def approximate_scores(matrix: DataFrame, key: str, features: list[str], k: int = 5, trees: int = TREES,
                       leaf_rows: int = LEAF_ROWS, seed: int = 42, name: str = "neighbour_score") -> DataFrame:
    """``neighbour_scores`` without the promise that all neighbours are found: a score is the true one or larger.

    Equal rows are merged and count as often as they occur.
    """
    rows = matrix.count()
    k = min(k, rows - 1)
    if k < 1:
        return matrix.select(key, F.lit(0.0).alias(name))
    points = materialise(matrix.groupBy(*features).agg(F.count(F.lit(1)).alias("copies"))
                         .withColumn("point", F.monotonically_increasing_id()), "points")
    distinct = points.count()
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    small = points.select(x.alias("x"), F.xxhash64("point", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE)
    sample = np.array([r["x"] for r in small.select("x").collect()]).reshape(-1, len(features))
    leaves = max(1, min(distinct // (4 * leaf_rows), len(sample) // SAMPLED_PER_LEAF))
    forest = [upper_tree(sample, leaves, np.random.default_rng([seed, t])) for t in range(trees)]
    shared = matrix.sparkSession.sparkContext.broadcast(forest)  # at most SAMPLE / SAMPLED_PER_LEAF directions a tree

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                own = np.stack(pdf["x"].to_numpy())
                for t, nodes in enumerate(shared.value):
                    yield pdf.assign(tree=t, leaf=leaf_of(own, nodes),
                                     along=own @ direction(own.shape[1], np.random.default_rng([seed, t, 1])))

    dealt = points.select("point", "copies", x.alias("x")).mapInPandas(
        deal, "point long, copies long, x array<double>, tree int, leaf int, along double")
    dealt = materialise(dealt, "dealt")
    sizes = dealt.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS)
    large = dealt.join(F.broadcast(sizes), ["tree", "leaf"]).groupBy("tree", "leaf").agg(F.array_distinct(F.percentile_approx(
        "along", [i / 64 for i in range(1, 64)], 1_000)).alias("edges"), F.first("n").alias("n"))
    steps = F.greatest(F.lit(1), F.floor(F.size("edges") * GROUP_ROWS / F.col("n")).cast("int"))
    edges = large.select("tree", "leaf", F.filter("edges", lambda e, i: (i % steps) == steps - 1).alias("edges"))
    cut = dealt.join(F.broadcast(edges), ["tree", "leaf"], "left").withColumn(
        "piece", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("along"))), F.lit(0)))

    def meet(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, ids, copies = np.stack(pdf["x"].to_numpy()), pdf["point"].to_numpy(), pdf["copies"].to_numpy()
        order = np.argsort(ids)  # the same leaves whatever the order of arrival
        out = []
        for part in local_leaves(own[order], leaf_rows, np.random.default_rng([seed, *map(int, group)])):
            part = order[part]
            places, distances = nearest_in(own[part], k)
            out.append(pd.DataFrame({"point": ids[part], "near": list(ids[part][places]), "many": list(copies[part][places]),
                                     "distance": list(distances)}))
        return pd.concat(out)

    met = cut.select("tree", "leaf", "piece", "point", "copies", "x").groupBy("tree", "leaf", "piece").applyInPandas(
        meet, "point long, near array<long>, many array<long>, distance array<double>")
    listed = met.select("point", F.arrays_zip("distance", "near", "many").alias("found"))
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))  # trees times k entries
    merged = listed.groupBy("point").agg(found.alias("found")).join(points.select("point", "copies", *features), "point")
    start = F.struct((F.col("copies") - 1).cast("long").alias("seen"), F.lit(0.0).alias("at"))
    last = F.aggregate("found", start, lambda a, s: F.when(a["seen"] >= k, a).otherwise(
        F.struct((a["seen"] + s["many"]).alias("seen"), s["distance"].alias("at"))))
    scored = merged.select(*features, last["at"].alias(name))
    return matrix.join(scored, features).select(key, name)


def score_recall(exact: DataFrame, approximate: DataFrame, key: str, name: str = "neighbour_score") -> DataFrame:
    """rows and recall: the share of rows whose k-th distance is the true one."""
    both = exact.select(key, F.col(name).alias("_e")).join(approximate.select(key, F.col(name).alias("_a")), key)
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.avg((F.col("_a") <= F.col("_e") * (1 + 1e-9) + 1e-9).cast("int")).alias("recall"))
