"""Vector search and chunking."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import documents as dc, search as vs


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:150] = x[50]  # a third are copies of one vector
    x[299] = 0.0
    rows = [(i, str(i % 3), [float(v) for v in row]) for i, row in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, source string, embedding array<float>").cache()


def best(x, i, k):
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    similarity = np.round(unit @ unit[i], 9)
    similarity[np.linalg.norm(x, axis=1) == 0] = -9
    return sorted(range(len(x)), key=lambda j: (-similarity[j], j))[:k]


@pytest.mark.parametrize("block_bytes", [64 * 1024 * 1024, 4000])
def test_search_many_equals_brute_force_in_one_block_and_in_many(vectors, block_bytes):
    x, df = vectors
    found = vs.search_many(df, df.filter("id < 60"), 5, block_bytes).toPandas()
    for i in (0, 10, 50, 55):
        mine = found[found["query_id"] == i].sort_values("position")["id"].tolist()
        assert mine == best(x, i, 5)


def test_index_search_with_all_cells_is_exact_and_few_cells_recall(vectors):
    _, df = vectors
    model, index = vs.build_index(df.filter("id < 299"), cells=6)
    exact = vs.search_many(df.filter("id < 299"), df.filter("id < 50"), 5)
    every = vs.search_index(model, index, df.filter("id < 50"), 5, probes=6, block_bytes=4000)
    assert sorted(exact.select("query_id", "id").collect()) == sorted(every.select("query_id", "id").collect())
    some = vs.search_index(model, index, df.filter("id < 50"), 5, probes=3)
    assert vs.recall(exact, some).first()["recall"] >= 0.5


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr(
        "vec_id AS id", "label AS source", "embedding")
    plan = vs.search(df, [0.1] * 64, 5, F.col("source") == 3)._jdf.queryExecution().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def python_chunks(text, size=500, overlap=50):
    text, out, start = text.strip(), [], 0
    while start < len(text):
        piece = text[start:start + size].strip()
        if piece:
            out.append(piece)
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(500, 50), (100, 70), (90, 0)])
def test_chunks_equal_a_sliding_window(spark, size, overlap):
    texts = ["Ceci est une phrase. " * 60, "", "     ", "é😀 " * 400, "x" * 450, "x" * 451, "a" + " " * 700 + "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = dc.chunk(df, ["doc_id"], size=size, overlap=overlap).orderBy("doc_id", "chunk_index").collect()
    for i, t in enumerate(texts):
        assert [r["content"] for r in rows if r["doc_id"] == i] == python_chunks(t, size, overlap)


def test_inserting_twice_adds_nothing(spark):
    df = spark.createDataFrame([(1, "a", "one"), (2, "a", "two"), (3, "b", "one"), (4, "b", "three")],
                               "pos long, source string, content string")
    batch = df.withColumn("chunk_id", dc.content_id(F.col("content")))
    empty = batch.limit(0)
    first = dc.insert_absent(empty, batch, ["pos"])
    assert sorted(r["pos"] for r in first.collect()) == [1, 2, 4]
    assert dc.insert_absent(first, batch, ["pos"]).count() == 0
    outcomes = dc.insert_outcomes(empty, batch, ["pos"])
    totals = {r["source"]: (r["inserted"], r["skipped"]) for r in dc.index_totals(outcomes).collect()}
    assert totals == {"a": (2, 0), "b": (1, 1)}
    assert dc.first_writers(batch, ["pos"], ["source"]).count() == 4


def test_encoder_hook_and_blank_texts(spark):
    df = spark.createDataFrame([(1, "un deux"), (2, "  "), (3, None)], "id long, content string")

    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    totals = dc.embedding_totals(dc.embed(df, encode)).first()
    assert (totals["total"], totals["embedded"]) == (3, 1)


def test_language(spark):
    texts = ["The price of the house is in the table and it is high",
             "Le prix de la maison est dans le tableau et il est élevé", "", None,
             "Der Preis ist nicht auf dem Papier und die Liste"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["id"]: r["language"] for r in dc.detect_language(df, "id").collect()}
    assert found == {0: "en", 1: "fr", 2: "fr", 3: "fr", 4: "fr"}


def test_language_agrees_with_given_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = dc.detect_language(df, "doc_id").join(df.filter("lang IN ('en', 'fr') AND n_chars > 200"), "doc_id")
    assert found.agg(F.avg(F.when(F.col("lang") == F.col("language"), 1.0).otherwise(0.0))).first()[0] > 0.9


def test_a_task_holds_few_similarities_at_once(monkeypatch):
    """Many queries against one block: bounded arrays, and the same rows however they are cut."""
    import tracemalloc
    rng = np.random.default_rng(1)
    queries, rows = vs.unit_rows(list(rng.normal(size=(3_000, 8)))), vs.unit_rows(list(rng.normal(size=(9_000, 8))))
    rows[5_000:5_300] = rows[0]  # equal vectors on both sides of a cut
    rows[7] = np.nan
    ids, query_ids = np.arange(9_000)[::-1].copy(), np.arange(3_000)
    tracemalloc.start()
    found = pd.concat(vs._best(query_ids, queries, ids, rows, 5), ignore_index=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all pairs at once take 216 MB
    monkeypatch.setattr(vs, "PAIRS", 1 << 40)
    monkeypatch.setattr(vs, "PAIR_ROWS", 1 << 40)
    whole = pd.concat(vs._best(query_ids, queries, ids, rows, 5), ignore_index=True)
    pd.testing.assert_frame_equal(found, whole)


def test_index_queries_in_blocks(spark):
    """Queries beyond one block are cut as well: the same result as in one."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))],
                                    "id long, embedding array<double>")
    model, index = vs.build_index(vectors, 3)
    one, many = (vs.search_index(model, index, vectors, 4, 3, block_bytes=b) for b in (1 << 26, 48 * 70))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(many) == rows(vs.search_many(vectors, vectors, 4))
