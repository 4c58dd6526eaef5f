"""A corpus pipeline: quality, exact copies, near copies, a mix of sources, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import exact_dedup, mixing, packing, quality, simhash
from lumenframe.llm.common import read
from lumenframe.session import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, "doc_id", "text", read(spark, sf_dir, "labels"), "quality")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, "doc_id", "text")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs, "doc_id", "text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, "doc_id", "text", "source", "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "doc_id", "text")


STAGES = [("quality classifier", good_quality), ("exact dedup", without_copies),
          ("SimHash near-dedup", without_near_copies), ("mixing sources to target weights", mixed),
          ("best-fit packing", packed)]
#: The classifier, SimHash's components and the packing plan have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
