"""Output forms shared by the registered queries: rounded numbers and text dates compare well across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rounded(name: str, digits: int = 4, alias: str | None = None) -> Column:
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(alias or name)


def day(name: str) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd").alias(name)


def moment(name: str) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def round_columns(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, rounded(c, digits))
    return df
