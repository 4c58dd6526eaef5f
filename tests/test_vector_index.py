"""The stored vector index: inserts, deletes, splits and searches without a rebuild."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import search as vs
from lumenframe.operators.vector_index import VectorIndex, two_means
from lumenframe.plans import stored as plans

SCHEMA = "id long, source string, embedding array<float>"


def vectors(spark, ids, seed=1, dimension=12, groups=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dimension))
    rows = [(int(i), f"s{i % 3}", [float(x) for x in middle[i % groups] + rng.normal(0, 0.4, dimension)]) for i in range(max(ids) + 1)]
    return spark.createDataFrame([rows[i] for i in ids], SCHEMA)


@pytest.fixture
def index(spark, tmp_path):
    df = vectors(spark, range(400))
    found = VectorIndex(spark, str(tmp_path), df.schema, 12, cell_rows=60)
    found.create(df, cells=5)
    return found


def exact(df, queries):
    return sorted((r["query_id"], r["position"], r["id"]) for r in vs.search_many(df, queries, 5).collect())


def check(index, df, queries):
    """With all cells probed the index finds what a search over all rows finds; by default nearly all of it."""
    every = index.search(queries, 5, probes=len(index.centres().rows)).collect()
    assert sorted((r["query_id"], r["position"], r["id"]) for r in every) == exact(df, queries)
    assert index.recall(queries).first()["recall"] >= 0.9


def test_life_of_an_index(spark, index):
    everything = vectors(spark, range(900))
    queries = everything.filter("id % 30 = 0")
    check(index, everything.filter("id < 400"), queries)
    before = {r["name"] for r in index.entries.files()}
    assert index.insert(everything.filter("id >= 300 AND id < 900"), "w", 0)
    assert not index.insert(everything.filter("id >= 300 AND id < 900"), "w", 0)
    assert before <= {r["name"] for r in index.entries.files()}  # nothing was rewritten
    check(index, everything, queries)
    assert index.delete_where(F.col("id") % 9 == 4) == 100 and index.delete_where(F.col("id") % 9 == 4) == 0
    left = everything.filter("id % 9 <> 4")
    check(index, left, queries)
    cut = index.split()
    assert cut and len(index.centres().rows) == 5 + len(cut)
    check(index, left, queries)
    assert index.compact(0.5) is None
    counts = index.compact()
    assert counts["hits"] == 100 and not index.gone.files()
    assert index.entries.read().count() == 800
    check(index, left, queries)


def test_deleted_ids_come_back(spark, index):
    df = vectors(spark, range(400))
    index.delete(df.filter("id < 10").select("id"))
    moved = df.filter("id < 5").withColumn("embedding", F.transform("embedding", lambda x: -x).cast("array<float>"))
    index.insert(moved)
    rows = {r["id"]: r["embedding"] for r in index.live().filter("id < 10").collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    assert rows == {r["id"]: r["embedding"] for r in moved.collect()}
    assert index.live().count() == 395 and index.entries.read().count() == 400


def test_odd_vectors_are_left_out(spark, index):
    odd = [(1000, "s", None), (1001, "s", [0.0] * 12), (1002, "s", [1.0]), (1003, "s", [float("nan")] + [1.0] * 11),
           (1004, "s", [None] + [1.0] * 11), (1005, "s", [float("inf")] + [1.0] * 11), (1006, "s", [1.0] * 12), (1006, "s", [1.0] * 12)]
    index.insert(spark.createDataFrame(odd, SCHEMA))
    assert [r["id"] for r in index.live().filter("id >= 1000").collect()] == [1006]
    assert index.insert(spark.createDataFrame([], SCHEMA))
    assert index.live().count() == 401


def test_equal_vectors_are_not_split():
    assert two_means(np.ones((5, 3)) / 3 ** 0.5) is None
    a, b = two_means(np.array([[1.0, 0], [0.9, 0.43589], [0, 1], [0.1, 0.995]]))
    assert min(a @ [1, 0], b @ [0, 1]) > 0.9 or min(b @ [1, 0], a @ [0, 1]) > 0.9


def test_recall_is_a_number(spark):
    got = plans.f09_stored_recall(spark, "/root/testdata/sf0.001").collect()
    assert [r["stage"] for r in got] == ["before", "after"] and all(0.9 <= r["recall"] <= 1 for r in got)
