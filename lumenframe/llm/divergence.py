"""Word divergence between the sources of each language, over collapsed duplicate texts.

Identical texts of a language become one row that carries how many rows each source has of it. Each such text is cut into
terms once; its counts and document frequencies enter with those numbers as weights. Pairs of sources are then compared
sparsely: terms that a source lacks all have the same share in it, so a sum over all kept terms is a sum over the values
that occur, corrected by the terms that both sources hold.

Shares are whole numbers in units of 1e-9, and all sums are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.llm.common import whole_text
from lumenframe.session import materialise

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
FLUSH = 2_000_000
#: The kept terms are sent to all tasks while they take no more than so many bytes; beyond that they are joined by a shuffle.
SENT_BYTES = 32 << 20

#: UTF-8 bytes: letters and bytes above 127 make terms, A-Z as a-z; all others part them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PARTIAL = "lang string, term string, docs long, counts array<struct<source string, n long>>"


def text_terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


class _Tally:
    """Weighted counts of a task's texts by (language, term) and source, in flat arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.terms: dict[tuple[str, bytes], int] = {}
        self.by_lang: dict[str, dict[bytes, int]] = {}
        self.sources: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        self.size = 0

    def add(self, lang: str, text: bytes, weights: list[tuple[str, int]]) -> None:
        found = Counter(text_terms(text))
        if not found:
            return
        known = self.by_lang.setdefault(lang, {})
        codes = np.empty(len(found), dtype=np.int64)
        for i, term in enumerate(found):
            code = known.get(term)
            if code is None:
                code = known[term] = len(self.terms)
                self.terms[lang, term] = code
            codes[i] = code
        counts = np.fromiter(found.values(), dtype=np.int64, count=len(found))
        for source, weight in weights:
            self.parts.append((codes, counts, self.sources.setdefault(source, len(self.sources)), weight))
            self.size += len(codes)

    def rows(self) -> pa.RecordBatch:
        """One row per (language, term): documents, and occurrences by source."""
        codes = np.concatenate([p[0] for p in self.parts])
        sources = np.repeat([p[2] for p in self.parts], [len(p[0]) for p in self.parts])
        key = codes * len(self.sources) + sources
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.add.reduceat(np.concatenate([p[1] * p[3] for p in self.parts])[order], first)
        docs = np.add.reduceat(np.repeat([p[3] for p in self.parts], [len(p[0]) for p in self.parts])[order], first)
        code, source = np.divmod(key[first], len(self.sources))
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])  # every code occurs, in order
        langs, terms = zip(*self.terms)
        names = pa.DictionaryArray.from_arrays(pa.array(source, pa.int32()), pa.array(list(self.sources), pa.string()))
        inner = pa.StructArray.from_arrays([names.cast(pa.string()), pa.array(counts)], ["source", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(code)], pa.int32()), inner)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array(np.add.reduceat(docs, start)), lists], ["lang", "term", "docs", "counts"])


def _term_counter(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            texts = batch.column("text")
            for i, (lang, weights) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "weights")))):
                tally.add(lang, texts[i].as_py(), [(w["source"], w["m"]) for w in weights])
                if tally.size >= most:
                    yield tally.rows()
                    tally.clear()
        if tally.parts:
            yield tally.rows()
    return run


def collapsed(rows: DataFrame) -> DataFrame:
    """``rows``: lang, source, text. One row per (lang, text): lang, text, weights (source, m)."""
    keyed = rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    weights = keyed.groupBy("lang", "sha", "source").agg(F.count(F.lit(1)).alias("m"))
    weights = weights.groupBy("lang", "sha").agg(F.collect_list(F.struct("source", "m")).alias("weights"))
    texts = keyed.groupBy("lang", "sha").agg(F.any_value("text").alias("text"))
    return texts.join(weights, ["lang", "sha"]).select("lang", "text", "weights")


def term_counts(rows: DataFrame, least_documents: int = LEAST_DOCUMENTS, flush: int = FLUSH) -> DataFrame:
    """``rows``: lang, source, text. lang, term, source, n of the terms in at least so many documents of their language.

    A task sends its sums on whenever it holds ``flush`` of them.
    """
    texts = collapsed(rows).withColumn("text", F.col("text").cast("binary"))
    partial = materialise(texts.mapInArrow(_term_counter(flush), PARTIAL), "term-parts")
    kept = partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents)
    kept = materialise(kept.select("lang", "term"), "kept-terms")
    size = kept.agg(F.sum(F.octet_length("lang") + F.octet_length("term") + 48)).first()[0] or 0
    found = partial.join(F.broadcast(kept) if size <= SENT_BYTES else kept.hint("shuffle_merge"), ["lang", "term"])
    return (found.select("lang", "term", F.inline("counts")).groupBy("lang", "term", "source")
            .agg(F.sum("n").alias("n")))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 (n + 2) / (total + 2 terms)), in decimals of 38 digits, so that no count overflows."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * wide(n + 2)
    return (F.call_function("div", top, F.nullif(wide(total + 2 * terms), F.lit(0).cast("decimal(20,0)"))) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 1e9 + 1, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(df: DataFrame, text: str, lang: str, source: str, least_documents: int = LEAST_DOCUMENTS,
          top: int = TOP_TERMS, flush: int = FLUSH) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the other sources of its language (part pair),
    and the terms it has most above its language (part term, the first ``top``).

    Null texts, languages and sources count as empty ones, which are a text, a language and a source like others.
    Repeated rows count each. A source without terms, and a language without kept terms, still have pairs (0 where nothing
    is kept). Ties go to the smaller item by UTF-8. An empty table gives an empty result.
    """
    rows = df.select(whole_text(lang).alias("lang"), whole_text(source).alias("source"), whole_text(text).alias("text"))
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")).drop("documents")
    counts = materialise(term_counts(rows, least_documents, flush), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = (groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
              .select("lang", "source", *[zero(c) for c in ("lang_total", "v", "total", "held")]))
    groups = materialise(groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("v"))), "source-groups")
    shares = materialise(counts.join(groups.drop("held"), ["lang", "source"]).select(
        "lang", "term", "source", "none", "v", "lang_total", share(F.col("n"), F.col("total"), F.col("v")).alias("p")),
        "term-shares")
    return _pairs(groups, shares).unionByName(_terms(shares, terms, top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """The sum of gaps over all kept terms for each two sources of a language.

    With values p where a source holds a term and ``none`` elsewhere: gaps of the values that occur against the other's
    ``none``, both ways; the gap of both ``none`` for all terms, less those that either holds; and for terms that both hold
    what is wrong with that.
    """
    left = groups.select("lang", "source", F.col("none").alias("none_a"), F.col("held").alias("held_a"), "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none_b"), F.col("held").alias("held_b"))
    two = left.join(right, "lang").filter("source <> item")
    values = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = (values.join(right.select("lang", "item", "none_b"), "lang").filter("source <> item")
             .groupBy("lang", "source", "item").agg(F.sum(gap(F.col("p"), F.col("none_b")) * F.col("times")).alias("alone")))
    a = shares.select("lang", "term", F.col("source").alias("source"), F.col("p").alias("p_a"), F.col("none").alias("none_a"))
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("none").alias("none_b"))
    pa_, pb, na, nb = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    both = (a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item")
            .agg(F.sum(gap(pa_, pb) - gap(pa_, nb) - gap(na, pb) + gap(na, nb)).alias("both")))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    key = ["lang", "source", "item"]
    none = F.when(F.col("v") > 0, gap(na, nb) * (F.col("v") - F.col("held_a") - F.col("held_b")))
    sums = [F.coalesce(c, F.lit(0)) for c in (none, F.col("alone"), F.col("back"), F.col("both"))]
    found = (two.join(alone, key, "left").join(back, key, "left").join(both, key, "left")
             .select(*key, (sums[0] + sums[1] + sums[2] + sums[3]).cast("long").alias("value")))
    return _ranked(found, "pair")


def _terms(shares: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    held = shares.join(terms, ["lang", "term"]).withColumn("q", q).filter("p > q")
    return _ranked(held.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")),
                   "term").filter(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.cast("int").alias("rank"))
