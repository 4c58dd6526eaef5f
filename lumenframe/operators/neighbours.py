"""Exact distance to the k-th nearest neighbour, distributed by cells of space."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.session import materialise

#: Points of a box, by the number of columns: the more there are, the more of a box lies near its border, and the more boxes a
#: point visits.
CELL_ROWS, FEW_ROWS, FEW_COLUMNS = 4_000, 500, 4
MAX_CELLS = 65_536
SPLIT_SAMPLE = 50_000
BLOCK = 1_024
#: Distances a task holds at once (8 bytes each).
PAIRS = 1 << 19


def split_space(sample: np.ndarray, cells: int) -> list[tuple]:
    """Median cuts of a sample into about ``cells`` boxes: ``(feature, cut, left, right)`` or ``(-1, cell, 0, 0)``."""
    nodes: list = []
    cell_count = 0

    def node(part: np.ndarray, wanted: int) -> int:
        nonlocal cell_count
        i = len(nodes)
        nodes.append(None)
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        f = int(np.argmax(spread))
        cut = float(np.median(part[:, f])) if len(part) > 1 and spread[f] > 0 else None
        if cut is not None and not (part[:, f] > cut).any():
            cut = float(np.nextafter(part[:, f].max(), -np.inf))
        if wanted <= 1 or cut is None:
            nodes[i] = (-1, cell_count, 0, 0)
            cell_count += 1
            return i
        low = part[:, f] <= cut
        left = node(part[low], wanted // 2)
        right = node(part[~low], wanted - wanted // 2)
        nodes[i] = (f, cut, left, right)
        return i

    node(sample, cells)
    return nodes


def cell_of(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    found = np.zeros(len(x), dtype=np.int32)
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        i, rows = waiting.pop()
        f, cut, left, right = nodes[i]
        if f < 0:
            found[rows] = cut
            continue
        low = x[rows, f] <= cut
        waiting += [(left, rows[low]), (right, rows[~low])]
    return found


def node_boxes(nodes: list[tuple], low: dict, high: dict, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounding box of every node from the boxes of its cells; an empty cell has an inverted box."""
    lo, hi = np.full((len(nodes), d), np.inf), np.full((len(nodes), d), -np.inf)
    for i in reversed(range(len(nodes))):
        f, cell, left, right = nodes[i]
        if f < 0:
            if cell in low:
                lo[i], hi[i] = low[cell], high[cell]
        else:
            lo[i], hi[i] = np.minimum(lo[left], lo[right]), np.maximum(hi[left], hi[right])
    return lo, hi


def near_cells(x: np.ndarray, reach: np.ndarray, nodes: list[tuple], lo: np.ndarray, hi: np.ndarray,
               home: int) -> list[list[int]]:
    """Per point the other cells closer than its reach, found by descending the tree of boxes."""
    rows_found, cells_found = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        i, rows = waiting.pop()
        gap = np.maximum(np.maximum(lo[i] - x[rows], x[rows] - hi[i]), 0.0)
        rows = rows[np.sqrt((gap * gap).sum(axis=1)) < reach[rows]]
        if not len(rows):
            continue
        f, cell, left, right = nodes[i]
        if f >= 0:
            waiting += [(left, rows), (right, rows)]
        elif cell != home:
            rows_found.append(rows)
            cells_found.append(np.full(len(rows), cell))
    rows, cells = np.concatenate(rows_found), np.concatenate(cells_found)
    order = np.argsort(rows, kind="stable")
    ends = np.searchsorted(rows[order], np.arange(1, len(x)))
    return [part.tolist() for part in np.split(cells[order], ends)]


def smallest(x: np.ndarray, points: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``x`` its ``k`` smallest distances to ``points``, counting copies; missing ones are infinite."""
    out = np.full((len(x), k), np.inf)
    if not len(points):
        return out
    lengths = (points * points).sum(axis=1)
    keep = min(k, len(points))
    block = max(1, min(BLOCK, PAIRS // len(points)))
    for start in range(0, len(x), block):
        part = x[start:start + block]
        square = np.maximum((part * part).sum(axis=1)[:, None] + lengths[None, :] - 2.0 * (part @ points.T), 0.0)
        best = np.argpartition(square, keep - 1, axis=1)[:, :keep]
        # The chosen few are measured again without cancellation.
        exact = np.sqrt(((part[:, None, :] - points[best]) ** 2).sum(axis=2))
        order = np.argsort(exact, axis=1, kind="stable")
        exact, many = np.take_along_axis(exact, order, 1), np.take_along_axis(copies[best], order, 1)
        if (many == 1).all():
            out[start:start + block, :keep] = exact
            continue
        reach = np.cumsum(many, axis=1)
        for j in range(k):
            first = (reach <= j).sum(axis=1)
            has = first < keep
            out[start:start + block, j][has] = exact[np.flatnonzero(has), first[has]]
    return out


def box_rows(columns: int) -> int:
    return min(CELL_ROWS, FEW_ROWS << max(0, columns - FEW_COLUMNS))


def neighbour_scores(matrix: DataFrame, key: str, features: list[str], k: int = 5, cell_rows: int | None = None,
                     name: str = "neighbour_score") -> DataFrame:
    """Distance of every row to its ``k``-th nearest other row, exact for any data.

    Equal rows are merged first, so copies never form a large group. Space is cut into boxes. A first pass measures
    inside the own box, which bounds the true distance; a second pass visits only the boxes that come closer than
    this bound. No pair of points leaves its task.
    """
    rows = matrix.count()
    k = min(k, rows - 1)
    if k < 1:
        return matrix.select(key, F.lit(0.0).alias(name))
    points = materialise(matrix.groupBy(*features).agg(F.count(F.lit(1)).alias("copies"))
                         .withColumn("point", F.xxhash64(*features)), "points")
    distinct = points.count()
    cells = max(1, min(MAX_CELLS, distinct // (cell_rows or box_rows(len(features)))))
    # The cuts come from a sample of bounded size; they decide the balance, never the result.
    share = min(1.0, max(SPLIT_SAMPLE, 4 * cells) / max(distinct, 1))
    sample = (points.select(*features).filter(F.pmod(F.col("point"), F.lit(1_000_003)) < max(1, int(1_000_003 * share)))
              .toPandas().to_numpy(dtype=float))
    nodes = split_space(sample, cells) if len(sample) else [(-1, 0, 0, 0)]
    shape = ", ".join(f"`{c}` double" for c in features)

    def place(batches):
        for pdf in batches:
            yield pdf.assign(cell=cell_of(pdf[features].to_numpy(dtype=float), nodes))

    placed = materialise(points.select(*features, "copies").mapInPandas(place, f"{shape}, copies long, cell int"),
                         "cells")
    boxes = placed.groupBy("cell").agg(*[F.min(c).alias(f"lo_{c}") for c in features],
                                       *[F.max(c).alias(f"hi_{c}") for c in features]).toPandas()
    low = dict(zip(boxes["cell"], boxes[[f"lo_{c}" for c in features]].to_numpy(dtype=float)))
    high = dict(zip(boxes["cell"], boxes[[f"hi_{c}" for c in features]].to_numpy(dtype=float)))
    shared = matrix.sparkSession.sparkContext.broadcast(node_boxes(nodes, low, high, len(features)))

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        x, copies = pdf[features].to_numpy(dtype=float), pdf["copies"].to_numpy()
        found = smallest(x, x, copies, k + 1)[:, 1:]
        lo, hi = shared.value
        targets = near_cells(x, found[:, k - 1], nodes, lo, hi, int(pdf["cell"].iloc[0]))
        return pdf.assign(best=list(found), targets=targets)

    local = materialise(placed.groupBy("cell").applyInPandas(
        at_home, f"{shape}, copies long, cell int, best array<double>, targets array<int>"), "local")
    away = local.select(*features, F.explode("targets").alias("target"))

    def visit(guests: pd.DataFrame, owners: pd.DataFrame) -> pd.DataFrame:
        x = guests[features].to_numpy(dtype=float)
        found = smallest(x, owners[features].to_numpy(dtype=float), owners["copies"].to_numpy(), k)
        return guests[features].assign(best=list(found))

    # A box that attracts very many visitors is split: its guests go to several tasks, each with the box's points.
    guests_per_task = 50_000
    sizes = away.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / guests_per_task).cast("int").alias("parts"))
    guests = (away.join(F.broadcast(sizes), "target")
              .withColumn("part", F.pmod(F.xxhash64(*features), F.col("parts")).cast("int")))
    pieces = sizes.select(F.col("target").alias("box"), F.col("parts").alias("pieces"))
    owners = (placed.select(*[F.col(c).alias(c) for c in [*features, "copies"]], F.col("cell").alias("box"))
              .join(F.broadcast(pieces), "box")
              .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))))
    visited = (guests.groupBy("target", "part").cogroup(owners.groupBy("box", "piece"))
               .applyInPandas(visit, f"{shape}, best array<double>"))
    # Each point has one short list per box it visited.
    merged = (local.select(*features, "best").unionByName(visited).groupBy(*features)
              .agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
              .select(*features, F.element_at("best", k).alias(name)))
    return matrix.join(merged, features).select(key, name)
