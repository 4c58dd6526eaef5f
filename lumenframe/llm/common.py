"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenframe.session import scratch_path

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
ROW = "_lf_row"
ROW_ID = "_lf_row_id"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh scratch path with its scheme, for files that tasks write themselves: a folder without a scheme is one of Spark's
    default file system, not of the executor's own disk."""
    path = scratch_path(spark, label)
    if "://" in path or path.startswith("file:"):
        return path
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def task_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that an operator's own columns can't clash with the caller's."""
    return F.struct(*[column(c).alias(c) for c in df.columns]).alias(ROW)


def unpacked(df: DataFrame, *more: Column) -> DataFrame:
    """Back to the caller's columns."""
    return df.select(f"{ROW}.*", *more)


def whole_text(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def without_null(id: str) -> list[Column]:
    """The id for Python, as ``id`` (0 for null) and ``no_id``: a null would make floats of a batch of ids."""
    return [F.coalesce(column(id).cast("long"), F.lit(0)).alias("id"), column(id).isNull().alias("no_id")]


def with_null(name: str) -> Column:
    """The id as it was."""
    return F.when(~F.col("no_id"), F.col("id")).alias(name)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], size: str, hot_share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key, ``size`` rows of ``rows`` each) without a hot task.

    Keys that hold at least one row in ``hot_share`` are at most ``hot_share`` in number; their table rows are
    broadcast, so their rows stay where they are. All other keys are joined by a shuffle. No key may be null.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    least = max(1, -(-total // hot_share))
    hot = table.filter(F.col(size) >= least)
    rest = table.filter(F.col(size) < least)
    few = rows.join(F.broadcast(hot), keys, "inner")
    many = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "inner")
    return few.unionByName(many)
