"""Pages, chunks, ids, idempotent storage, index totals and language."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenframe.functions.text import blocks, is_blank, sliding_pieces, strip

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50

# Frequent function words per language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this",
           "are", "from", "at", "an", "or", "which", "have", "has", "not"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "dans", "pour", "sur",
           "par", "au", "aux", "ce", "il", "elle", "ne", "pas", "avec"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "von", "mit", "auf", "ein", "eine", "den", "dem", "zu", "sich",
           "des", "für", "im", "auch", "als", "wird", "dass", "sie", "er", "ich"],
    "es": ["el", "los", "las", "de", "y", "que", "en", "un", "una", "es", "por", "con", "para", "del", "al", "se",
           "su", "lo", "como", "más", "pero", "sus", "no", "la", "este"],
}
DIMENSIONS = 384


def clean_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank pages with stripped text."""
    return pages.filter(~is_blank(F.col(text))).withColumn(text, strip(F.col(text)))


def page_totals(pages: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    n = F.count(F.lit(1))
    kept = F.count_if(~is_blank(F.col(text)))
    return pages.groupBy(source).agg(n.alias("total_pages"), kept.alias("extracted_pages"),
                                     F.round(kept / n * 100, 2).alias("extraction_rate"))


def chunk(pages: DataFrame, keep: list[str], text: str = "text", size: int = CHUNK_SIZE,
          overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Sliding windows over the whole text of every page: ``keep`` columns, ``chunk_index`` and ``content``."""
    step = size - overlap
    cut = pages.select(*keep, blocks(strip(F.col(text)), step).alias("_blocks"))
    windows = F.transform(sliding_pieces(F.col("_blocks"), size, step), strip)
    return cut.select(*keep, F.posexplode(F.filter(windows, lambda c: c != "")).alias("chunk_index", "content"))


def position_id(source: Column, page: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("_", source.cast("string"), page.cast("string"), index.cast("string")), 256)


def content_id(content: Column) -> Column:
    return F.left(F.md5(F.coalesce(content, F.lit(""))), F.lit(16))


def first_writers(chunks: DataFrame, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """One row per ``chunk_id``: the first in ``order``. ``scope=["source"]`` keeps one per source instead.

    An aggregate with map-side combine, so thousands of copies of one chunk meet as one row per task.
    """
    keys = ["chunk_id", *(scope or [])]
    rest = [c for c in chunks.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return chunks.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*chunks.columns)


def insert_absent(stored: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: one per ``chunk_id``, none that is stored already."""
    return first_writers(batch, order).join(stored.select("chunk_id"), "chunk_id", "left_anti").select(*batch.columns)


def insert_outcomes(stored: DataFrame, batch: DataFrame, order: list[str], failed: Column | None = None) -> DataFrame:
    """``batch`` with an ``outcome`` per row: inserted, skipped or failed.

    Winners come from an aggregate over ``(chunk_id, order)`` and not from a window per chunk, so that a chunk with
    very many copies needs no single task.
    """
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    marked = batch.withColumn("_bad", bad)
    winners = (marked.filter(~F.col("_bad")).groupBy("chunk_id").agg(F.min(F.struct(*order)).alias("_first"))
               .join(stored.select("chunk_id"), "chunk_id", "left_anti"))
    # Only the winning position joins back: its key is unique per row, so no copy group is hot.
    winning = winners.select(*[F.col(f"_first.{c}").alias(c) for c in order], F.lit(True).alias("_won"))
    return (marked.join(winning, order, "left")
            .withColumn("outcome", F.when(F.col("_bad"), "failed").when(F.col("_won"), "inserted")
                        .otherwise("skipped"))
            .drop("_bad", "_won"))


def index_totals(outcomes: DataFrame, by: str = "source") -> DataFrame:
    one = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("total_chunks"), one("inserted"), one("skipped"),
                                    one("failed"))


def first_chunks(chunks: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Optional cap: the first ``limit`` chunks per document."""
    rank = Window.partitionBy(*by).orderBy(*order)
    return chunks.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= limit).drop("_rank")


def source_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.col("chunks").desc(), "source")


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources"),
                      F.count_distinct("chunk_id").alias("distinct_chunks"))


def delete_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """``(remaining, counts)``: rows where the condition holds go; unknown counts as not matching."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(~hit), df.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("remaining"))


def reindex_source(stored: DataFrame, source: str, batch: DataFrame, order: list[str]) -> DataFrame:
    """Drop everything of ``source`` and insert ``batch`` into what is left."""
    left, _ = delete_rows(stored, F.col("source") == source)
    return left.unionByName(insert_absent(left, batch, order))


# Embedding -----------------------------------------------------------------------------------------------------

def fit_text_encoder(chunks: DataFrame, dimension: int = DIMENSIONS, text: str = "content"):
    """Default encoder: hashed words, weighted by rarity, unit length. Returns fitted stages."""
    from pyspark.ml import Pipeline
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(chunks.filter(~is_blank(F.col(text))))


def embed(chunks: DataFrame, encoder, text: str = "content") -> DataFrame:
    """``chunks`` with an ``embedding`` array; blank texts get none.

    ``encoder`` is a fitted text encoder or a function over batches of pandas series, applied with Arrow.
    """
    filled = chunks.filter(~is_blank(F.col(text)))
    if callable(encoder) and not hasattr(encoder, "transform"):
        vector = F.pandas_udf(encoder, "array<float>")
        done = filled.withColumn("embedding", vector(F.col(text)))
    else:
        done = (encoder.transform(filled).withColumn("embedding", vector_to_array("_unit", "float32"))
                .drop("_words", "_counts", "_weights", "_unit"))
    blank = chunks.filter(is_blank(F.col(text))).withColumn("embedding", F.lit(None).cast("array<float>"))
    return done.unionByName(blank)


def embedding_totals(embedded: DataFrame) -> DataFrame:
    n, done = F.count(F.lit(1)), F.count("embedding")
    return embedded.agg(n.alias("total"), done.alias("embedded"),
                        F.round(F.coalesce(F.try_divide(done, n), F.lit(0.0)) * 100, 2).alias("success_rate"))


# Language ------------------------------------------------------------------------------------------------------

def _word_table(spark: SparkSession) -> DataFrame:
    """One row per function word with a 0/1 flag per language: a fixed, small table."""
    words = sorted({w for listed in FUNCTION_WORDS.values() for w in listed})
    rows = [(w, *[int(w in listed) for listed in FUNCTION_WORDS.values()]) for w in words]
    return spark.createDataFrame(rows, "word string, " + ", ".join(f"{x} int" for x in FUNCTION_WORDS))


def language_scores(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, one count of function words per language)`` over whole texts.

    Words meet the word table in a broadcast join and are counted before the shuffle.
    """
    words = df.select(key, F.explode_outer(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word"))
    return (words.join(F.broadcast(_word_table(df.sparkSession)), "word", "left").groupBy(key)
            .agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in FUNCTION_WORDS]))


def detect_language(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, language)``: en for English, fr for French, blank and everything else."""
    others = F.greatest(*[F.col(x) for x in FUNCTION_WORDS if x != "en"])
    english = (F.col("en") > 0) & (F.col("en") > others)
    return language_scores(df, key, text).select(key, F.when(english, "en").otherwise("fr").alias("language"))
