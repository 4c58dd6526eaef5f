"""Approximate nearest neighbours: inverted lists searched by an adaptive dimension scan.

Vectors are rotated by a random orthogonal matrix, so that the first columns of a difference are a random sample of it.
Within each probed list a query reads its candidates in blocks of columns; after each block a hypothesis test compares
the scaled partial distance with the distance of the k-th best so far, and drops candidates that are surely farther.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lumenframe.llm.common import column
from lumenframe.session import materialise

MOST_LISTS = 4_096
SAMPLE_PER_LIST = 16
ROUNDS = 12
SEED = 7
COLUMNS = 16
EPSILON = 2.1
SLACK = 1e-20
LIST_ROWS = 8_192
QUERY_ROWS = 1_024
TRIAL_QUERIES = 64
AIM = 0.975


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """id, v (array of double): one row per id, without null, zero or non-finite vectors and without null ids.

    The most common length (of equal counts the smaller) is the dimension; other lengths take no part. If an id has
    several vectors, the smallest in array order counts.
    """
    rows = df.select(column(id).cast("long").alias("id"), column(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(
        finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    first = sizes.first()
    width = first["d"] if first else 0
    return materialise(rows.filter(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v")), "vectors")


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres ** 2).sum(axis=1)[None, :] - 2 * (x @ centres.T)


def fit_centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Lloyd's rounds from distinct sampled vectors; a list that loses all its vectors keeps its centre."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[np.sort(rng.choice(len(distinct), min(lists, len(distinct)), replace=False))]
    for _ in range(rounds):
        own = np.concatenate([_nearest(sample[i:i + 4096], centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def scan(x: np.ndarray, q: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> np.ndarray:
    """Positions in ``x`` of the candidates that stay in the race for the ``k`` nearest to ``q``; both are rotated.

    Chunks grow, so the bound is set early. A candidate is dropped after s of d columns if its partial squared distance
    times d / s exceeds the bound times (1 + epsilon / sqrt(s)) squared. A small slack, relative to the length of ``q``,
    covers the rounding of the rotated values: copies of ``q`` are at a distance of about 0, not all at the same.
    """
    d, slack = x.shape[1], SLACK * (q ** 2).sum()
    kept, distances, bound = [], np.zeros(0), np.inf
    at, size = 0, max(64, 4 * k)
    while at < len(x):
        alive = np.arange(at, min(at + size, len(x)))
        partial = np.zeros(len(alive))
        for start in range(0, d, columns):
            end = min(start + columns, d)
            difference = x[alive, start:end] - q[start:end]
            partial += np.einsum("ij,ij->i", difference, difference)
            if end < d and bound < np.inf:
                stays = partial * (d / end) <= bound * (1 + epsilon / np.sqrt(end)) ** 2 + slack
                if not stays.all():
                    alive, partial = alive[stays], partial[stays]
                    if not len(alive):
                        break
        kept.append(alive)
        distances = np.concatenate([distances, partial])
        if len(distances) > k:
            bound = np.partition(distances, k - 1)[k - 1]
        at, size = at + size, size * 4
    places = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
    if len(places) > k:
        places = places[distances <= bound * (1 + 1e-9) + 1e-12 + slack]
    return places


class Index:
    """Centres of the lists, the rotation, list sizes and the number of lists that a query probes."""

    def __init__(self, centres: np.ndarray, rotation: np.ndarray):
        self.centres, self.rotation = centres, rotation
        self.sizes, self.queries, self.probes = np.zeros(len(centres), dtype=np.int64), None, 1

    def assign(self):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["v"])
                    own = np.concatenate([_nearest(x[i:i + 4096], self.centres).argmin(axis=1)
                                          for i in range(0, len(x), 4096)])
                    yield batch.assign(list=own, rotated=list(x @ self.rotation))
        return run

    def probe(self, need: int):
        """The lists of each query: ``probes`` nearest ones, and more until they hold ``need`` vectors."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    rows = batch.iloc[at:at + 1024]
                    order = np.argsort(_nearest(_matrix(rows["v"]), self.centres), axis=1, kind="stable")
                    held = np.cumsum(self.sizes[order], axis=1)
                    count = np.minimum(np.maximum((held < need).sum(axis=1) + 1, self.probes), order.shape[1])
                    where = np.repeat(np.arange(len(rows)), count)
                    lists = np.concatenate([o[:c] for o, c in zip(order, count)])
                    yield pd.DataFrame({"id": rows["id"].to_numpy()[where], "v": rows["v"].to_numpy()[where],
                                        "list": lists})
        return run


def _searcher(k: int, rotation: np.ndarray):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            x, r, ids = _matrix(vectors["v"]), _matrix(vectors["rotated"]), vectors["id"].to_numpy()
            for query, q in zip(queries["id"].to_numpy(), _matrix(queries["v"])):
                places = scan(r, q @ rotation, k + 1)
                places = places[ids[places] != query]
                exact = np.sqrt(((x[places] - q) ** 2).sum(axis=1))
                best = np.lexsort((ids[places], exact))[:k]
                out += [(query, ids[places[b]], exact[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def _brute(ids: np.ndarray, q: np.ndarray, k: int):
    """The ``k`` nearest of each batch to a bounded set of queries, with the lists they are in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, own = _matrix(batch["v"]), batch["id"].to_numpy()
            far = _nearest(q, x) + (q ** 2).sum(axis=1)[:, None]
            far[ids[:, None] == own[None, :]] = np.inf
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(q)), best.shape[1])
            best = best.reshape(-1)
            yield pd.DataFrame({"query": rows, "list": batch["list"].to_numpy()[best], "far": far[rows, best]})
    return run


def build_index(vectors: DataFrame, queries: DataFrame, k: int, aim: float = AIM) -> tuple[Index, DataFrame]:
    """Fit centres on a bounded sample, put every vector in a list, and set how many lists a query probes.

    sqrt(rows) lists, at most ``MOST_LISTS``, are fitted on ``SAMPLE_PER_LIST`` vectors each, those smallest by a hash of
    the id. ``TRIAL_QUERIES`` queries are compared with all vectors, and as many lists are probed as hold the share
    ``aim`` of their true neighbours.
    """
    n = vectors.count()
    lists = int(min(MOST_LISTS, max(1, np.ceil(np.sqrt(n)))))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(lists * SAMPLE_PER_LIST).toPandas()
    x = _matrix(sample["v"])
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(x.shape[1], x.shape[1])))[0]
    index = Index(fit_centres(x, lists), rotation)
    table = materialise(vectors.mapInPandas(index.assign(), "id long, v array<double>, list long, rotated array<double>"),
                        "index")
    for r in table.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        index.sizes[r["list"]] = r["n"]
    trial = queries.orderBy(F.xxhash64("id"), "id").limit(TRIAL_QUERIES).toPandas()
    if len(trial):
        q = _matrix(trial["v"])
        found = table.mapInPandas(_brute(trial["id"].to_numpy(), q, k), "query long, list long, far double")
        nearest = Window.partitionBy("query").orderBy("far", "list")
        true = found.filter(F.col("far") < float("inf")).withColumn("r", F.row_number().over(nearest)).filter(
            F.col("r") <= k).toPandas()
        ranks = np.argsort(np.argsort(_nearest(q, index.centres), axis=1, kind="stable"), axis=1, kind="stable")
        if len(true):
            at = np.sort(ranks[true["query"].to_numpy(), true["list"].to_numpy()])
            index.probes = int(at[min(len(at) - 1, int(np.ceil(aim * len(at))) - 1)]) + 1
    return index, table


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, aim: float = AIM) -> DataFrame:
    """``vectors``, ``queries``: id, v. For each query its ``k`` nearest found: query_id, rank, vec_id, score.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id; a query's
    own id is no candidate. Lists are cut into blocks of ``LIST_ROWS`` vectors and ``QUERY_ROWS`` queries, so neither a
    full list nor a popular one lands in one task.
    """
    spark = vectors.sparkSession
    if not vectors.limit(1).count() or not queries.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, table = build_index(vectors, queries, k, aim)
    probes = materialise(queries.mapInPandas(index.probe(k + 1), "id long, v array<double>, list long"), "probes")
    asked = probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    blocks = [(r["list"], int(-(-index.sizes[r["list"]] // LIST_ROWS)), -(-r["n"] // QUERY_ROWS)) for r in asked]
    cut = F.broadcast(spark.createDataFrame(blocks, "list long, vector_blocks long, query_blocks long"))
    own = F.pmod(F.xxhash64("id"), F.col("vector_blocks"))
    dealt = table.join(cut, "list").select("list", own.alias("vb"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("qb"), "id", "v", "rotated")
    own = F.pmod(F.xxhash64("id"), F.col("query_blocks"))
    asking = probes.join(cut, "list").filter(F.col("vector_blocks") > 0).select("list", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("vector_blocks") - 1)).alias("vb"), own.alias("qb"), "id", "v")
    found = (dealt.groupBy("list", "vb", "qb").cogroup(asking.groupBy("list", "vb", "qb"))
             .applyInPandas(_searcher(k, index.rotation), "query_id long, vec_id long, score double"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Brute force for a small set of queries, to measure recall: query_id, vec_id, score."""
    asked = queries.toPandas()
    ids, q = asked["id"].to_numpy(), _matrix(asked["v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, own = _matrix(batch["v"]), batch["id"].to_numpy()
            for query, v in zip(ids, q):
                far = np.sqrt(((x - v) ** 2).sum(axis=1))
                far[own == query] = np.inf
                best = np.lexsort((own, far))[:k]
                best = best[far[best] < np.inf]
                yield pd.DataFrame({"query_id": query, "vec_id": own[best], "score": far[best]})

    found = vectors.mapInPandas(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
