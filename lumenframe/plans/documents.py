"""Registered queries over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.text import WHITESPACE
from lumenframe.operators import documents as dc, search as vs
from lumenframe.plans.inputs import table, view
from lumenframe.plans.shape import rounded

ORDER = ["doc_id", "chunk_index"]


def _pages(spark, sf):
    return view(spark, sf, "chunks_input")


def _chunks(spark, sf):
    chunks = dc.chunk(_pages(spark, sf), ["doc_id", "source", "page"])
    return chunks.withColumn("chunk_id", dc.content_id(F.col("content")))


def a07_clean_pages(spark, sf):
    return dc.clean_pages(_pages(spark, sf)).select("doc_id", "text")


def a07_page_totals(spark, sf):
    return dc.page_totals(_pages(spark, sf))


def f01_chunks(spark, sf):
    return dc.chunk(_pages(spark, sf), ["doc_id"]).select("doc_id", "chunk_index", "content")


def f02_position_ids(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_index", dc.position_id(
        F.col("source"), F.col("page"), F.col("chunk_index")).alias("position_id"))


def f03_first_writers(spark, sf):
    return dc.first_writers(_chunks(spark, sf), ORDER).select("chunk_id", "doc_id", "chunk_index")


def f03_first_writers_per_source(spark, sf):
    """One copy per source, so shared text stays visible under every source."""
    return dc.first_writers(_chunks(spark, sf), ORDER, ["source"]).select("chunk_id", "source", "doc_id", "chunk_index")


def f04_first_chunks(spark, sf):
    return dc.first_chunks(_chunks(spark, sf), ["doc_id"], ["chunk_index"], 300).select("doc_id", "chunk_index")


def a11_insert_absent(spark, sf):
    chunks = _chunks(spark, sf)
    stored = dc.first_writers(chunks.filter(F.col("source").isin("src1", "src2")), ORDER)
    return dc.insert_absent(stored, chunks, ORDER).select("chunk_id", "doc_id", "chunk_index")


def f13_index_totals(spark, sf):
    chunks = _chunks(spark, sf)
    stored = dc.first_writers(chunks.filter(F.col("source").isin("src1", "src2")), ORDER)
    failed = F.char_length("content") < 3
    return dc.index_totals(dc.insert_outcomes(stored, chunks, ORDER, failed))


def a13_delete_counts(spark, sf):
    _, counts = dc.delete_rows(_chunks(spark, sf), F.col("source") == "src3")
    return counts


def a13_remaining(spark, sf):
    left, _ = dc.delete_rows(_chunks(spark, sf), F.col("source") == "src3")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def f12_reindex_source(spark, sf):
    stored = dc.first_writers(_chunks(spark, sf), ORDER)
    fresh = _chunks(spark, sf).filter(F.col("source") == "src3")
    return dc.reindex_source(stored, "src3", fresh, ORDER).select("chunk_id", "source")


def f11_source_counts(spark, sf):
    return dc.source_counts(_chunks(spark, sf))


def f11_corpus_counts(spark, sf):
    return dc.corpus_counts(_chunks(spark, sf))


def f05_embedding_totals(spark, sf):
    """Default encoder over all chunks: counts, and how many vectors have length one or zero."""
    chunks = _chunks(spark, sf)
    embedded = dc.embed(chunks, dc.fit_text_encoder(chunks))
    square = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    proper = (F.abs(square - 1) < 1e-4) | (square == 0)
    return embedded.agg(F.count(F.lit(1)).alias("total"), F.count("embedding").alias("embedded"),
                        F.count_if(proper).alias("unit_or_zero"),
                        F.count_if(F.size("embedding") == dc.DIMENSIONS).alias("right_size"))


def f16_language(spark, sf):
    return dc.detect_language(table(spark, sf, "documents"), "doc_id")


def _vectors(spark, sf):
    return view(spark, sf, "vectors")


def f06_dimensions(spark, sf):
    return vs.dimension_check(_vectors(spark, sf), 64)


def _query(spark, sf):
    return _vectors(spark, sf).filter(F.col("id") == 0).first()["embedding"]


def f07_search(spark, sf):
    return vs.search(_vectors(spark, sf), _query(spark, sf), 5).select("id", "source", "similarity")


def f08_search_in_source(spark, sf):
    return vs.search(_vectors(spark, sf), _query(spark, sf), 5, F.col("source") == "3").select("id", "source", "similarity")


def _questions(spark, sf):
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    return _vectors(spark, sf).filter(F.col("id") % 50 == 0)


def _found(spark, sf):
    return vs.search_many(_vectors(spark, sf), _questions(spark, sf), 5)


def f10_search_many(spark, sf):
    return _found(spark, sf).select("query_id", "id", "position", rounded("similarity"))


def _passages(spark, sf):
    text = _pages(spark, sf).select(F.col("doc_id").alias("id"), "source", "page", F.col("text").alias("content"))
    return _found(spark, sf).join(text, "id")


def f10_previews(spark, sf):
    return vs.with_preview(_passages(spark, sf)).select("query_id", "position", "source", "preview")


def f14_prompts(spark, sf):
    questions = table(spark, sf, "documents").filter(F.col("doc_id") % 50 == 0).select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("Passages like "), F.col("doc_id").cast("string"))
        .alias("question"), F.col("lang").alias("language"))
    return vs.prompts(_passages(spark, sf), questions)


def f15_citations(spark, sf):
    return vs.citations(_passages(spark, sf).withColumn("similarity", F.round("similarity", 4)), "en")


def f09_index_recall(spark, sf):
    vectors = _vectors(spark, sf)
    model, index = vs.build_index(vectors)
    return vs.recall(_found(spark, sf), vs.search_index(model, index, _questions(spark, sf), 5)).select(
        "expected", (F.col("recall") >= 0.9).alias("enough"))


def f09_index_search(spark, sf):
    """Every cell probed: the same as the exact search."""
    vectors = _vectors(spark, sf)
    model, index = vs.build_index(vectors)
    return vs.search_index(model, index, _questions(spark, sf), 5, probes=len(model.clusterCenters())).select(
        "query_id", "id", "position", rounded("similarity"))


_BLANK = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
_CHUNKS = f"""s AS (SELECT doc_id, source, page, trim(text, {_BLANK}) AS t FROM chunks_input),
p AS (SELECT doc_id, source, page, t, unnest(range(0, length(t), 450)) AS p FROM s),
c AS (SELECT doc_id, source, page, p, trim(substr(t, p + 1, 500), {_BLANK}) AS content FROM p),
chunks AS (SELECT doc_id, source, page, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER)
  AS chunk_index, content, substr(md5(content), 1, 16) AS chunk_id FROM c WHERE content <> '')"""
_FIRST = """first AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY doc_id, chunk_index)
  AS rn FROM chunks) WHERE rn = 1)"""
_STORED = "stored AS (SELECT DISTINCT chunk_id FROM chunks WHERE source IN ('src1', 'src2'))"
_SIM = """sim AS (SELECT q.id AS query_id, v.id, v.source,
  ROUND(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS similarity
  FROM vectors q, vectors v WHERE q.id % 50 = 0)"""
_TOP = _SIM + """, found AS (SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id
  ORDER BY similarity DESC, id) AS INTEGER) AS position FROM sim) WHERE position <= 5)"""
_PASSAGES = _TOP + """, passages AS (SELECT f.query_id, f.position, f.similarity, d.source, d.page, d.text AS content
  FROM found f JOIN chunks_input d ON d.doc_id = f.id)"""


def _words_sql(language):
    listed = ", ".join(f"'{w}'" for w in dc.FUNCTION_WORDS[language])
    return f"len(list_filter(w, lambda x: x IN ({listed}))) AS s_{language}"


_INSTRUCTION = {k: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for k, v in vs.INSTRUCTIONS.items()}

SQL = {
    "a07_clean_pages": f"""SELECT doc_id, trim(text, {_BLANK}) AS text FROM chunks_input
WHERE trim(text, {_BLANK}) <> ''""",
    "a07_page_totals": f"""SELECT source, COUNT(*) AS total_pages,
  COUNT(*) FILTER (WHERE trim(text, {_BLANK}) <> '') AS extracted_pages,
  ROUND(COUNT(*) FILTER (WHERE trim(text, {_BLANK}) <> '') / COUNT(*) * 100, 2) AS extraction_rate
FROM chunks_input GROUP BY 1""",
    "f01_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, content FROM chunks",
    "f02_position_ids": f"""WITH {_CHUNKS} SELECT doc_id, chunk_index,
  sha256(source || '_' || page || '_' || chunk_index) AS position_id FROM chunks""",
    "f03_first_writers": f"WITH {_CHUNKS}, {_FIRST} SELECT chunk_id, doc_id, chunk_index FROM first",
    "f03_first_writers_per_source": f"""WITH {_CHUNKS} SELECT chunk_id, source, doc_id, chunk_index FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY chunk_id, source ORDER BY doc_id, chunk_index) AS rn FROM chunks) WHERE rn = 1""",
    "f04_first_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_index FROM chunks WHERE chunk_index < 300",
    "a11_insert_absent": f"""WITH {_CHUNKS}, {_FIRST}, {_STORED} SELECT chunk_id, doc_id, chunk_index FROM first
WHERE chunk_id NOT IN (SELECT chunk_id FROM stored)""",
    "f13_index_totals": f"""WITH {_CHUNKS}, {_STORED}, good AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id
  ORDER BY doc_id, chunk_index) AS rn FROM chunks WHERE length(content) >= 3),
won AS (SELECT source, COUNT(*) AS n FROM good WHERE rn = 1 AND chunk_id NOT IN (SELECT chunk_id FROM stored)
  GROUP BY 1),
tot AS (SELECT source, COUNT(*) AS total_chunks, COUNT(*) FILTER (WHERE length(content) < 3) AS failed
  FROM chunks GROUP BY 1)
SELECT source, total_chunks, COALESCE(n, 0) AS inserted, total_chunks - failed - COALESCE(n, 0) AS skipped, failed
FROM tot LEFT JOIN won USING (source)""",
    "a13_delete_counts": f"""WITH {_CHUNKS} SELECT COUNT(*) FILTER (WHERE source = 'src3') AS deleted,
  COUNT(*) FILTER (WHERE source <> 'src3') AS remaining FROM chunks""",
    "a13_remaining": f"""WITH {_CHUNKS} SELECT source, COUNT(*) AS chunks FROM chunks WHERE source <> 'src3'
GROUP BY 1""",
    "f12_reindex_source": f"""WITH {_CHUNKS}, {_FIRST}, kept AS (SELECT chunk_id, source FROM first
  WHERE source <> 'src3') SELECT chunk_id, source FROM kept UNION ALL SELECT DISTINCT chunk_id, 'src3' FROM chunks
WHERE source = 'src3' AND chunk_id NOT IN (SELECT chunk_id FROM kept)""",
    "f11_source_counts": f"WITH {_CHUNKS} SELECT source, COUNT(*) AS chunks FROM chunks GROUP BY 1",
    "f11_corpus_counts": f"""WITH {_CHUNKS} SELECT COUNT(*) AS chunks, COUNT(DISTINCT source) AS sources,
  COUNT(DISTINCT chunk_id) AS distinct_chunks FROM chunks""",
    "f05_embedding_totals": f"""WITH {_CHUNKS} SELECT COUNT(*) AS total, COUNT(*) AS embedded,
  COUNT(*) AS unit_or_zero, COUNT(*) AS right_size FROM chunks""",
    "f16_language": f"""WITH l AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}]+') AS w FROM documents),
n AS (SELECT doc_id, {', '.join(_words_sql(x) for x in dc.FUNCTION_WORDS)} FROM l)
SELECT doc_id, CASE WHEN s_en > 0 AND s_en > s_fr AND s_en > s_de AND s_en > s_es THEN 'en' ELSE 'fr' END AS language
FROM n""",
    "f06_dimensions": """SELECT CAST(len(embedding) AS INTEGER) AS dimension, COUNT(*) AS rows, len(embedding) = 64 AS ok
FROM vectors GROUP BY len(embedding)""",
    "f07_search": f"""WITH {_SIM} SELECT id, source, ROUND(similarity, 4) AS similarity FROM sim WHERE query_id = 0
ORDER BY sim.similarity DESC, id LIMIT 5""",
    "f08_search_in_source": f"""WITH {_SIM} SELECT id, source, ROUND(similarity, 4) AS similarity FROM sim
WHERE query_id = 0 AND source = '3' ORDER BY sim.similarity DESC, id LIMIT 5""",
    "f10_search_many": f"WITH {_TOP} SELECT query_id, id, position, ROUND(similarity, 4) AS similarity FROM found",
    "f10_previews": f"""WITH {_PASSAGES} SELECT query_id, position, source, substr(content, 1, 100) || '...' AS preview
FROM passages""",
    "f14_prompts": f"""WITH {_PASSAGES}, ctx AS (SELECT query_id, string_agg('[Source ' || position || ': ' || source
  || ', page ' || page || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY position) AS c
  FROM passages GROUP BY 1)
SELECT doc_id AS query_id, CASE WHEN lang = 'en' THEN {_INSTRUCTION['en']} ELSE {_INSTRUCTION['fr']} END || chr(10) || chr(10)
  || 'CONTEXTE:' || chr(10) || CASE WHEN length(c) > 3000 THEN substr(c, 1, 3000) || '...' ELSE coalesce(c, '') END || chr(10)
  || chr(10) || 'QUESTION: Passages like ' || doc_id || chr(10) || chr(10) || 'RÉPONSE:' AS prompt
FROM (SELECT * FROM documents WHERE doc_id % 50 = 0) LEFT JOIN ctx ON doc_id = query_id""",
    "f15_citations": f"""WITH {_PASSAGES}, one AS (SELECT query_id, source, page, MIN(position) AS position,
  arg_min(similarity, position) AS similarity FROM passages GROUP BY 1, 2, 3)
SELECT query_id, '**Sources consulted:**' || string_agg(chr(10) || '- ' || source || ' (page ' || page
  || ', similarity: ' || printf('%.2f', ROUND(similarity, 4)) || ')', '' ORDER BY position) AS citations FROM one GROUP BY 1""",
    "f09_index_recall": f"WITH {_TOP} SELECT COUNT(*) AS expected, true AS enough FROM found",
    "f09_index_search": f"WITH {_TOP} SELECT query_id, id, position, ROUND(similarity, 4) AS similarity FROM found",
}

QUERIES = [a07_clean_pages, a07_page_totals, f01_chunks, f02_position_ids, f03_first_writers,
           f03_first_writers_per_source, f04_first_chunks, a11_insert_absent, f13_index_totals, a13_delete_counts,
           a13_remaining, f12_reindex_source, f11_source_counts, f11_corpus_counts, f05_embedding_totals,
           f16_language, f06_dimensions, f07_search, f08_search_in_source, f10_search_many, f10_previews,
           f14_prompts, f15_citations, f09_index_search, f09_index_recall]
