"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.llm import (divergence, exact_dedup, fill_in_middle, line_dedup, lm, mixing, neighbours, packing, quality,
                            secrets, simhash, token_counts, warc)
from lumenframe.llm.common import ROW_ID, read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.score_documents(documents, "doc_id", "text", labels, "quality")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), "doc_id", "text")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"), "doc_id", "text", "doc_id", "source")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), "doc_id", "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.delete_repeats(documents, "text", "doc_id")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter(F.col("id") % 100 == 0))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), "doc_id", "text").drop(ROW_ID)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"), "doc_id", "text").drop(ROW_ID, "component")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), "page_id", "url", "html")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), "text", "lang", "source")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"), "doc_id", "text", written=True)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(read(spark, sf_dir, "documents"), "doc_id", "text")


SPAN_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
p(kind, k, pattern) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'), ('owned', 3, '[A-Za-z0-9+/_-]+')),
a AS (SELECT r, source, doc_id, 'assign' AS kind, 0 AS k, text,
    '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS pattern,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
    regexp_split_to_array(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g
  FROM base
  UNION ALL SELECT r, source, doc_id, 'access', 1, text, '', regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS m, m,
    regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM base
  UNION ALL SELECT r, source, doc_id, 'hex', 2, text, '', regexp_extract_all(text, '[0-9a-f]+') AS m, m,
    regexp_split_to_array(text, '[0-9a-f]+') FROM base
  UNION ALL SELECT r, source, doc_id, 'owned', 3, text, '', regexp_extract_all(text, '[A-Za-z0-9+/_-]+') AS m, m,
    regexp_split_to_array(text, '[A-Za-z0-9+/_-]+') FROM base),
e AS (SELECT r, doc_id, source, kind, k, unnest(m) AS m, unnest(v) AS v, unnest(g[:len(m)]) AS gap,
    unnest(range(len(m))) AS i FROM a WHERE len(m) > 0),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM e),
f AS (SELECT r, doc_id, source, kind, k, v, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s
  WHERE CASE k WHEN 0 THEN length(v) >= 12 WHEN 1 THEN length(v) >= 18 WHEN 2 THEN length(v) >= 16
    ELSE length(v) >= 24 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
      AND len(list_distinct(string_split(v, ''))) >= 10 END),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(source, chr(0)) || ' '
    || coalesce(CAST(doc_id AS VARCHAR), chr(0))) AS repositories FROM f GROUP BY v),
w AS (SELECT f.*, owners = 1 AND repositories < 10 AS live, owners >= 3 OR repositories >= 10 AS copied
  FROM f JOIN own USING (v) WHERE k < 3 OR (owners = 1 AND repositories < 10)),
x AS (SELECT * FROM w WHERE k < 3 OR NOT EXISTS
  (SELECT 1 FROM w b WHERE b.r = w.r AND b.k < 3 AND b.start < w.stop AND w.start < b.stop)),
t AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base_list,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans,
  count(*) FILTER (k = 3) AS n_owned, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_list, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM base LEFT JOIN t USING (r)"""

LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    md5(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS h FROM l),
q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY line_no) - 1 AS seq FROM w WHERE words > 0),
e AS (SELECT a.r AS r0, b.r, b.seq, b.words, b.seq - a.seq AS shift FROM q a JOIN q b ON a.h = b.h
    AND (a.r < b.r OR (a.r = b.r AND a.seq < b.seq))),
m AS (SELECT *, seq - row_number() OVER (PARTITION BY r0, r, shift ORDER BY seq) AS run FROM e),
n AS (SELECT r, min(seq) AS first, max(seq) AS last FROM m GROUP BY r0, r, shift, run HAVING sum(words) >= 50),
c AS (SELECT DISTINCT r, unnest(range(first, last + 1)) AS seq FROM n),
g AS (SELECT c.r, c.seq, q.line_no, c.seq - row_number() OVER (PARTITION BY c.r ORDER BY c.seq) AS island
  FROM c JOIN q USING (r, seq)),
p AS (SELECT r, list(line_no) AS gone, count(DISTINCT island) AS n_runs FROM g GROUP BY r),
b AS (SELECT l.r, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT list_contains(gone, line_no)) AS kept
  FROM l JOIN p USING (r) GROUP BY l.r)
SELECT doc_id, CASE WHEN p.r IS NULL THEN text ELSE coalesce(kept, '') END AS text, len(lines) AS n_lines,
  coalesce(len(gone), 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs
FROM d LEFT JOIN p USING (r) LEFT JOIN b USING (r)"""

COPIES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(plain) AS text_sha256 FROM d WINDOW w AS (PARTITION BY plain)"""

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, 2.0::DOUBLE * sum(size) AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM s),
f AS (SELECT *, (SELECT arg_min(rate, most / weight) FROM r WHERE rate < most / weight) AS final FROM r),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR most <= weight * final THEN most ELSE weight * final END AS target
  FROM f),
o AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
  + greatest(0, least(size, budget - budget // source_size * source_size - before)) END AS taken FROM o"""

PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM p"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM e WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o
WHERE part = 'pair' OR rank <= 10"""

MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
n AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS one,
    CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS two,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(one, two)], '') AS a,
    array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS b, array_to_string(u[greatest(one, two) + 1:], '') AS c
  FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

QUERIES = [op1_quality_classifier, op2_best_fit_packing, op3_secret_scans, op4_token_counts, op5_line_dedup,
           op6_nearest_neighbours, op7_exact_dedup, op8_simhash_near_dedup, op9_source_mixing, op10_warc_normaliser,
           op11_source_divergence, op12_lm_scores, op13_fill_in_middle]
SQL = {"op3_secret_scans": SPAN_SQL, "op5_line_dedup": LINE_SQL, "op7_exact_dedup": COPIES_SQL,
       "op9_source_mixing": MIX_SQL, "op10_warc_normaliser": PAGES_SQL,
       "op11_source_divergence": DIVERGENCE_SQL, "op13_fill_in_middle": MIDDLE_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
