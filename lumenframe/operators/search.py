"""Vector search: exact, filtered, many queries at once, and with an inverted-file index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.functions.text import fixed
from lumenframe.functions.vectors import dot, norm
from lumenframe.session import scratch_path

TOP_K = 5
BLOCK_BYTES = 64 * 1024 * 1024
#: Similarities a task holds at once (8 bytes each), and the vectors of a block that they are cut by.
PAIRS, PAIR_ROWS = 1 << 20, 4_096
# Index: the share of true neighbours to be found, and the queries that set how many cells that takes.
AIM, TRIAL_QUERIES = 0.95, 64
PREVIEW_CHARS = 100
CONTEXT_CHARS = 3000



def _found_schema(queries: DataFrame, vectors: DataFrame, query_id: str = "id") -> str:
    """Identifiers keep the types of their tables."""
    kind = {c: t for c, t in queries.dtypes}[query_id]
    return f"query_id {kind}, id {dict(vectors.dtypes)['id']}, similarity double"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has the usual length: the most frequent one, of equal ones the smaller."""
    there = vectors.filter(F.col("embedding").isNotNull())
    usual = (there.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "d").limit(1).collect())
    return there.filter(F.size("embedding") == (usual[0]["d"] if usual else 0))


def dimension_check(vectors: DataFrame, expected: int, column: str = "embedding") -> DataFrame:
    """``(dimension, rows, ok)`` per vector length."""
    return (vectors.groupBy(F.size(column).alias("dimension")).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("ok", F.col("dimension") == expected))


def search(vectors: DataFrame, query: list[float], k: int = TOP_K, condition: Column | None = None) -> DataFrame:
    """The ``k`` vectors nearest to ``query`` by cosine. A condition applies before ranking and reaches the scan."""
    rows = vectors if condition is None else vectors.filter(condition)
    target = F.array(*[F.lit(float(x)) for x in query])
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    ranked = rows.withColumn("similarity", F.try_divide(dot(F.col("embedding"), target),
                                                        norm(F.col("embedding")) * F.lit(length)))
    return (ranked.filter(F.col("similarity").isNotNull())
            .orderBy(F.round("similarity", 9).desc(), "id").limit(k)
            .withColumn("similarity", F.round("similarity", 4)))


def unit_rows(arrays) -> np.ndarray:
    """Stacked vectors scaled to length one; zero vectors become NaN and never match."""
    x = np.vstack(arrays).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The ``k`` best rows of one block for every query of one block, ``PAIRS`` similarities at a time: a query's best of all
    rows are among its best of each part."""
    step = max(1, PAIRS // max(1, min(PAIR_ROWS, len(rows))))
    for start in range(0, len(queries), step):
        parts = [_best_part(query_ids[start:start + step], queries[start:start + step], ids[at:at + PAIR_ROWS],
                            rows[at:at + PAIR_ROWS], k) for at in range(0, len(rows), PAIR_ROWS)]
        yield parts[0] if len(parts) == 1 else _first(pd.concat(parts), k)


def _best_part(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """``_best`` of a few rows, ties at the edge included."""
    similarity = queries @ rows.T
    np.round(similarity, 9, out=similarity)
    similarity[np.isnan(similarity)] = -np.inf
    if (n := similarity.shape[1]) > k:
        edge = np.partition(similarity, n - k, axis=1)[:, n - k:n - k + 1]
    else:
        edge = np.full((len(queries), 1), -np.inf)
    where = np.nonzero((similarity >= edge) & np.isfinite(similarity))
    return _first(pd.DataFrame({"query_id": query_ids[where[0]], "id": ids[where[1]], "similarity": similarity[where]}), k)


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
    return found[found.groupby("query_id").cumcount() < k]


def _merge(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))
    return (found.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= k))


def search_many(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact top ``k`` per query: ``(query_id, id, similarity, position)``.

    Each block of vectors yields only its own best ``k`` per query, so pairs never leave a task. Queries that fit in
    one checked block travel to the vectors; otherwise both sides are cut into blocks and every block pair is one
    task of bounded size.
    """
    vectors = usable(vectors.select("id", "embedding"))
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return vectors.sparkSession.createDataFrame([], _found_schema(queries, vectors) + ", position int")
    queries = queries.filter(F.size("embedding") == width)
    row_bytes = 8 * width + 16
    query_count = queries.count()
    if query_count * row_bytes <= block_bytes:
        return _merge(_search_local(vectors, queries, k), k)
    query_blocks = -(-query_count * row_bytes // block_bytes)
    vector_blocks = max(1, -(-vectors.count() * row_bytes // block_bytes))
    left = _blocked(queries.withColumnRenamed("id", "query_id"), "query_id", "_q", query_blocks, "_v", vector_blocks)
    right = _blocked(vectors.select("id", "embedding"), "id", "_v", vector_blocks, "_q", query_blocks)
    return _merge(_search_blocks(left, right, ["_q", "_v"], k), k)


def _blocked(df: DataFrame, key: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Rows get one block by hash and are copied to every block of the other side."""
    return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))))


def _search_local(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select("id", "embedding").collect()
    found = _found_schema(queries, vectors)
    if not rows:
        return vectors.sparkSession.createDataFrame([], found)
    shared = vectors.sparkSession.sparkContext.broadcast(
        (np.array([r["id"] for r in rows]), unit_rows([r["embedding"] for r in rows])))

    def scan(batches):
        query_ids, units = shared.value
        for pdf in batches:
            if len(pdf):
                yield from _best(query_ids, units, pdf["id"].to_numpy(), unit_rows(pdf["embedding"].to_list()), k)

    return vectors.select("id", "embedding").mapInPandas(scan, found)


def _search_blocks(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": a["query_id"][:0], "id": b["id"][:0], "similarity": np.zeros(0)})
        return pd.concat(_best(a["query_id"].to_numpy(), unit_rows(a["embedding"].to_list()), b["id"].to_numpy(),
                               unit_rows(b["embedding"].to_list()), k))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        match, _found_schema(left, right, "query_id"))


# Inverted-file index -------------------------------------------------------------------------------------------

def build_index(vectors: DataFrame, cells: int | None = None, seed: int = 42) -> tuple[KMeansModel, DataFrame]:
    """Cells by k-means on cosine distance; the vectors are written partitioned by cell.

    Unless ``cells`` is given there are as many as the square root of the vectors. Null vectors, vectors without length
    and those of another dimension are not indexed.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    vectors = usable(vectors).filter(square > 0)
    if cells is None:
        cells = max(2, math.ceil(math.sqrt(vectors.count())))
    shaped = vectors.withColumn("_v", array_to_vector("embedding"))
    model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell", distanceMeasure="cosine",
                   maxIter=20).fit(shaped)
    path = scratch_path(vectors.sparkSession, "vector-index")
    model.transform(shaped).drop("_v").write.partitionBy("cell").parquet(path)
    return model, vectors.sparkSession.read.parquet(path)


def trial_probes(model: KMeansModel, index: DataFrame, queries: DataFrame, k: int = TOP_K, aim: float = AIM) -> int:
    """How many cells a query has to probe: as many as hold the share ``aim`` of the true neighbours of trial queries.

    ``TRIAL_QUERIES`` queries, those smallest by a hash of the id, are compared with all vectors of the index.
    """
    centres = unit_rows([c for c in model.clusterCenters()])
    rows = (queries.filter(F.size("embedding") == centres.shape[1]).orderBy(F.xxhash64("id"), "id")
            .limit(TRIAL_QUERIES).select("embedding").collect())
    if not rows:
        return 1
    order = np.argsort(-(unit_rows([r["embedding"] for r in rows]) @ centres.T), axis=1)
    ranks = np.argsort(order, axis=1)
    trial = queries.sparkSession.createDataFrame([(i, r["embedding"]) for i, r in enumerate(rows)],
                                                 f"id long, embedding {dict(queries.dtypes)['embedding']}")
    found = _merge(_search_local(index, trial, k), k).select("query_id", "id")
    cells = index.select("id", "cell").join(F.broadcast(found), "id").select("query_id", "cell").collect()
    if not cells:
        return 1
    at = np.sort([ranks[r["query_id"], r["cell"]] for r in cells])
    return int(at[math.ceil(aim * len(at)) - 1]) + 1


def search_index(model: KMeansModel, index: DataFrame, queries: DataFrame, k: int = TOP_K, probes: int | None = None,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Approximate top ``k``: only the ``probes`` cells nearest to a query are searched.

    Unless ``probes`` is given, trial queries set it (``trial_probes``, one more pass over the index). Large cells are cut
    into blocks of bounded size and the queries of a cell visit each of its blocks.
    """
    centres = unit_rows([c for c in model.clusterCenters()])
    probes = min(trial_probes(model, index, queries, k) if probes is None else probes, len(centres))
    queries = queries.filter(F.size("embedding") == centres.shape[1])
    kinds = dict(queries.dtypes)
    step = max(1, PAIRS // max(1, len(centres)))

    def nearest(batches):
        for pdf in batches:
            for start in range(0, len(pdf), step):
                own = pdf.iloc[start:start + step]
                order = np.argsort(-(unit_rows(own["embedding"].to_list()) @ centres.T), axis=1)[:, :probes]
                yield own.assign(cells=list(order.astype(np.int32)))

    row_bytes = 8 * centres.shape[1] + 16
    parts = max(1, -(-queries.count() * row_bytes // block_bytes))  # a cell's queries are cut into blocks as well
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * row_bytes / block_bytes).cast("int")
                                      .alias("pieces"))
    probed = (queries.select(F.col("id").alias("query_id"), "embedding")
              .mapInPandas(nearest, f"query_id {kinds['id']}, embedding {kinds['embedding']}, cells array<int>")
              .select("query_id", "embedding", F.explode("cells").alias("cell"))
              .join(F.broadcast(sizes), "cell")
              .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
              .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
              .select("query_id", "embedding", "cell", "piece", "part"))
    rows = (index.join(F.broadcast(sizes), "cell")
            .withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
            .select("id", "embedding", "cell", "piece", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")))
    return _merge(_search_blocks(probed, rows, ["cell", "piece", "part"], k), k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact results that the approximate search found."""
    hits = exact.select("query_id", "id").join(approximate.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("hits")).withColumn(
        "expected", exact.agg(F.count(F.lit(1))).scalar()).withColumn(
        "recall", F.try_divide(F.col("hits"), F.col("expected")))


# Prompt and citations ------------------------------------------------------------------------------------------

# Instruction per language.
INSTRUCTIONS = {
    "en": ("You are an expert assistant in data analysis and French regulation.\n"
           "Answer the question based ONLY on the provided context.\n"
           "If the context does not contain the answer, say so clearly.\n"
           "Always cite your sources (document name and page number).\n"
           "Answer in English."),
    "fr": ("Tu es un assistant expert en analyse de données et réglementation française.\n"
           "Réponds à la question en te basant UNIQUEMENT sur le contexte fourni.\n"
           "Si la réponse n'est pas dans le contexte, dis-le clairement.\n"
           "Cite toujours tes sources (nom du document et numéro de page).\n"
           "Réponds en français."),
}


# What stands for a source or page that is not known.
NO_SOURCE, NO_PAGE = "inconnu", "?"


def _source() -> Column:
    return F.coalesce("source", F.lit(NO_SOURCE))


def _page() -> Column:
    return F.coalesce(F.col("page").cast("string"), F.lit(NO_PAGE))


def with_preview(found: DataFrame, content: str = "content") -> DataFrame:
    return found.withColumn("preview", F.concat(F.left(content, F.lit(PREVIEW_CHARS)), F.lit("...")))


def prompts(found: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, prompt)`` from ranked chunks ``(query_id, position, source, page, content)``.

    The context is at most ``k`` chunks per query and is cut at 3,000 characters. ``questions`` holds query_id,
    question and language.
    """
    passage = F.concat(F.lit("[Source "), F.col("position").cast("string"), F.lit(": "), _source(), F.lit(", page "), _page(), F.lit("]\n"),
                       F.coalesce("content", F.lit("")))
    # Nothing beyond the cut of one passage can reach the prompt, so each passage is cut before the shuffle.
    bounded = F.left(passage, F.lit(CONTEXT_CHARS + 1))
    joined = (found.select("query_id", "position", bounded.alias("passage")).groupBy("query_id")
              .agg(F.array_sort(F.collect_list(F.struct("position", "passage"))).alias("passages"))
              .withColumn("context", F.array_join(F.transform("passages", lambda p: p["passage"]), "\n\n")))
    context = F.when(F.char_length("context") > CONTEXT_CHARS,
                     F.concat(F.left("context", F.lit(CONTEXT_CHARS)), F.lit("..."))).otherwise(F.col("context"))
    instruction = F.when(F.col("language") == "en", INSTRUCTIONS["en"]).otherwise(INSTRUCTIONS["fr"])
    return (questions.join(joined, "query_id", "left")
            .select("query_id", F.concat(instruction, F.lit("\n\nCONTEXTE:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQUESTION: "),
                                         F.coalesce("question", F.lit("")), F.lit("\n\nRÉPONSE:")).alias("prompt")))


def citations(found: DataFrame, language: str = "fr") -> DataFrame:
    """``(query_id, citations)``: distinct (source, page) in rank order with two-digit similarity."""
    first = (found.groupBy("query_id", "source", "page")
             .agg(F.min(F.struct("position", "similarity")).alias("best")))
    word, head = (("similarity", "**Sources consulted:**") if language == "en" else
                  ("similarité", "**Sources consultées :**"))
    line = F.concat(F.lit("\n- "), _source(), F.lit(" (page "), _page(),
                    F.lit(f", {word}: "), fixed(F.col("best.similarity"), 2), F.lit(")"))
    return (first.withColumn("line", line).groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("best.position", "line"))).alias("lines"))
            .select("query_id", F.concat(F.lit(head), F.array_join(F.transform(
                "lines", lambda x: x["line"]), "")).alias("citations")))
