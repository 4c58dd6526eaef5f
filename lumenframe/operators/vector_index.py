"""A stored vector index that takes inserts and deletes.

Centres are fitted on a bounded sample: ``SAMPLE_PER_CELL`` vectors a cell, at most ``MOST_CELLS`` cells, which also bounds what
travels to the tasks (8 bytes a number: 12 MB for 384 dimensions). Every vector is an entry of the cell of its nearest centre,
in a stored table parted by cell. Inserts append to cells; deletes are tombstones, which searches leave out and a compaction
turns into rewritten files; cells that have grown beyond their size are split in two, and only their files are written anew.

Each step is a version of one table, in an order in which a search between two steps finds every entry.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenframe.operators import search as vs
from lumenframe.operators.stored import StoredTable

SAMPLE_PER_CELL = 64
MOST_CELLS = 4_096
CELL_ROWS = 100_000
SPLIT_SAMPLE = 4_096
#: Tombstones, as a share of the entries, from which on a compaction is due.
GONE_SHARE = 0.1


class Centres:
    """Centres by cell, in the form in which searches ask for them."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.rows)


def usable(vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows whose vector has the index's length, only finite numbers and is not zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return vectors.filter(v.isNotNull() & (F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0))


class VectorIndex:
    """``path``: a shared folder. ``schema``: that of the vectors, with ``id`` and ``embedding`` among the columns."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, dimension: int, cell_rows: int = CELL_ROWS,
                 seed: int = 42):
        self.spark, self.dimension, self.cell_rows, self.seed, self.columns = spark, dimension, cell_rows, seed, schema.names
        numbers = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])
        self.entries = StoredTable(spark, f"{path}/entries", T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())]),
                                   ["cell"])
        self.places = StoredTable(spark, f"{path}/centres", numbers, [])
        self.gone = StoredTable(spark, f"{path}/gone", T.StructType([schema["id"]]), [])

    # Centres ---------------------------------------------------------------------------------------------------

    def centres(self) -> Centres:
        rows = sorted(self.places.read().collect(), key=lambda r: r["cell"])
        return Centres(np.array([r["centre"] for r in rows], dtype=float).reshape(len(rows), self.dimension))

    def _store_centres(self, rows: np.ndarray) -> None:
        frame = self.spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], self.places.schema)
        self.places.overwrite_partitions(frame.coalesce(1))

    def _nearest(self, vectors: DataFrame, centres: np.ndarray, cells: list[int] | None = None) -> DataFrame:
        """``vectors`` with the ``cell`` of the nearest of ``centres``; ``cells``: their numbers."""
        units = vs.unit_rows(list(centres))
        numbers = np.arange(len(units)) if cells is None else np.array(cells)
        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

        step = max(1, vs.PAIRS // max(1, len(units)))

        def assign(batches):
            for pdf in batches:
                for start in range(0, len(pdf), step):
                    own = pdf.iloc[start:start + step]
                    yield own.assign(cell=numbers[np.argmax(vs.unit_rows(own["embedding"].to_list()) @ units.T, axis=1)])

        return vectors.mapInPandas(assign, schema)

    # Changes ---------------------------------------------------------------------------------------------------

    def create(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Fit centres on the sample of the vectors smallest by a hash of their id, and store all vectors."""
        rows = usable(vectors.select(*self.columns), self.dimension)
        if cells is None:
            n = rows.count()
            cells = min(MOST_CELLS, max(2, math.ceil(math.sqrt(n)), -(-n // self.cell_rows)))
        sample = rows.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(cells * SAMPLE_PER_CELL)
        model = KMeans(k=cells, seed=self.seed, featuresCol="_v", distanceMeasure="cosine", maxIter=20).fit(
            sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("_v")))
        self._store_centres(np.array(model.clusterCenters()))
        self.entries.append(self._nearest(rows, np.array(model.clusterCenters())))

    def insert(self, vectors: DataFrame, writer: str | None = None, epoch: int | None = None) -> bool:
        """Add vectors whose id is not there; of equal ids in the batch one is taken. An id that was deleted may come back. A
        batch that its writer has written already changes nothing."""
        fresh = usable(vectors.select(*self.columns), self.dimension)
        rest = [c for c in self.columns if c != "id"]
        fresh = fresh.groupBy("id").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_r")).select("id", "_r.*")
        fresh = fresh.select(*self.columns)
        back = self.gone.read().join(fresh.select("id"), "id", "left_semi")
        if back.limit(1).count():
            self.entries.delete_matching(back, ["id"])
            self.gone.delete_matching(fresh.select("id"), ["id"])
        fresh = fresh.join(self.entries.read().select("id"), "id", "left_anti")
        return self.entries.append(self._nearest(fresh, self.centres().rows), writer, epoch)

    def delete(self, ids: DataFrame) -> int:
        """Mark entries as gone; returns how many were there."""
        hits = self.live().select("id").join(ids.select("id").distinct(), "id", "left_semi")
        before = sum(r["amount"] for r in self.gone.files())
        self.gone.append(hits)
        return sum(r["amount"] for r in self.gone.files()) - before

    def delete_where(self, condition: Column) -> int:
        return self.delete(self.live().filter(condition).select("id"))

    def compact(self, share: float = GONE_SHARE) -> dict | None:
        """Rewrite the files that hold marked entries, if these are at least ``share`` of all."""
        gone, total = (sum(r["amount"] for r in t.files()) for t in (self.gone, self.entries))
        if not gone or gone < share * total:
            return None
        counts = self.entries.delete_matching(self.gone.read(), ["id"])
        self.gone.delete(F.lit(True))
        return counts

    def split(self) -> list[int]:
        """Cut cells of more than twice ``cell_rows`` entries in two; returns the cells cut. The centres come first, so that a
        search finds entries before and after they have moved."""
        sizes: dict[int, int] = {}
        for r in self.entries.files():
            sizes[int(r["part"])] = sizes.get(int(r["part"]), 0) + r["amount"]
        centres, done = self.centres().rows, []
        for cell in sorted(c for c, n in sizes.items() if n > 2 * self.cell_rows):
            rows = self.entries.read().filter(F.col("cell") == cell)
            sample = rows.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(SPLIT_SAMPLE).select("embedding").collect()
            two = two_means(vs.unit_rows([r["embedding"] for r in sample]), self.seed)
            if two is None or len(centres) >= MOST_CELLS:
                continue
            centres = np.vstack([centres, two[1]])
            centres[cell] = two[0]
            self._store_centres(centres)
            self.entries.overwrite_partitions(self._nearest(rows.drop("cell"), np.array(two), [cell, len(centres) - 1])
                                              .select(*self.columns, "cell"))
            done.append(cell)
        return done

    # Searches --------------------------------------------------------------------------------------------------

    def live(self) -> DataFrame:
        return self.entries.read().join(self.gone.read(), "id", "left_anti").select(*self.columns, "cell")

    def search(self, queries: DataFrame, k: int = vs.TOP_K, probes: int | None = None) -> DataFrame:
        """Top ``k`` entries per query; trial queries set how many cells are probed unless ``probes`` is given."""
        return vs.search_index(self.centres(), self.live(), queries, k, probes)

    def recall(self, queries: DataFrame, k: int = vs.TOP_K, probes: int | None = None) -> DataFrame:
        """hits, expected and recall of a search against all live entries."""
        return vs.recall(vs.search_many(self.live(), queries, k), self.search(queries, k, probes))


def two_means(units: np.ndarray, seed: int = 42, rounds: int = 20) -> tuple[np.ndarray, np.ndarray] | None:
    """Two centres of unit rows by cosine; None if they can't be told apart."""
    rng = np.random.default_rng(seed)
    first = units[rng.integers(len(units))]
    a = units[np.argmin(units @ first)]
    b = units[np.argmin(units @ a)]
    if np.allclose(a, b):
        return None
    for _ in range(rounds):
        left = units @ a >= units @ b
        if left.all() or not left.any():
            return None
        a, b = (x / np.linalg.norm(x) for x in (units[left].mean(axis=0), units[~left].mean(axis=0)))
    return a, b
