"""Exact duplicates by a tree merge of sorted digest runs.

Every partition holds a sorted run of digests. In each round the runs of two neighbouring groups meet: the groups merge,
and the digest space is cut once more among their members, so every round keeps the same number of tasks and none gathers
the whole. That is a binomial exchange: n tasks take the logarithm of n to base 2 as rounds. ``fan_in`` lets more groups meet
in one round, whose runs are then merged many ways at once. A merge reads its runs in order and keeps one entry
per digest: the smallest identifier and the number of rows. Entries merge only if SHA-256, a second hash of the text
and its length agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.common import ROW, ROW_ID, SPACES, column, look_up, packed, task_count, unpacked, whole_text
from lumenframe.session import materialise

FAN_IN = 2
KEY = ["sha", "second", "length"]
ORDER = ["target", *KEY, "id_null", "id", "row"]
RUN = "target long, sha binary, second long, length long, id_null boolean, id long, row long, n long"


def _merge_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One entry per (target, digest) of rows in order; the first row of each holds the smallest identifier."""
    carry = None
    for batch in batches:
        if carry is not None:
            batch = pd.concat([carry, batch], ignore_index=True)
        if not len(batch):
            continue
        starts = np.ones(len(batch), dtype=bool)
        same = np.ones(len(batch) - 1, dtype=bool)
        for name in ("target", *KEY):
            values = batch[name].to_numpy()
            same &= values[1:] == values[:-1]
        starts[1:] = ~same
        first = np.flatnonzero(starts)
        merged = batch.iloc[first].copy()
        merged["n"] = np.add.reduceat(batch["n"].to_numpy(), first)
        carry = merged.iloc[-1:]
        yield merged.iloc[:-1]
    if carry is not None:
        yield carry


def digests(df: DataFrame, text: str) -> DataFrame:
    """Add ``sha``, ``second`` and ``length`` of the text with every run of white space as one space."""
    plain = F.regexp_replace(whole_text(text), SPACES, " ")
    return (df.withColumn("_plain", plain)
            .withColumns({"sha": F.unhex(F.sha2(F.col("_plain"), 256)), "second": F.xxhash64("_plain"),
                          "length": F.length("_plain").cast("long")})
            .drop("_plain"))


def merge_runs(rows: DataFrame, tasks: int, fan_in: int = FAN_IN) -> DataFrame:
    """``rows``: run, row, id and KEY. One row per digest: KEY, keep_id, keep_row and group_size.

    A target is a group of runs and a slice of the digest space. After round k a group spans base^k runs and a slice is
    one part in base^k, so the number of targets stays the same. Each run is merged in itself before the first exchange,
    so copies within a run never travel.
    """
    rounds = max(1, math.ceil(math.log(max(tasks, 2), fan_in) - 1e-9))
    base = max(2, math.ceil(tasks ** (1 / rounds) - 1e-9))
    runs = base ** rounds
    place = F.pmod(F.xxhash64("sha"), F.lit(runs))
    merged = rows.select(F.pmod("run", F.lit(runs)).cast("long").alias("target"), *KEY,
                         F.col("id").isNull().alias("id_null"), F.coalesce("id", F.lit(0)).cast("long").alias("id"),
                         "row", F.lit(1).cast("long").alias("n"))
    merged = merged.sortWithinPartitions(*ORDER).mapInPandas(_merge_sorted, RUN)
    for k in range(1, rounds + 1):
        group = F.floor(F.col("target") / F.lit(base ** k)) * F.lit(base ** k)
        part = F.floor(place / F.lit(base ** (rounds - k)))
        merged = (merged.withColumn("target", (group + part).cast("long"))
                  .repartitionById(runs, F.col("target").cast("int"))
                  .sortWithinPartitions(*ORDER)
                  .mapInPandas(_merge_sorted, RUN))
    return merged.select(*KEY, F.when(~F.col("id_null"), F.col("id")).alias("keep_id"), F.col("row").alias("keep_row"),
                         F.col("n").alias("group_size"))


def exact_groups(df: DataFrame, id: str, text: str, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept and text_sha256, and the row's number ``ROW_ID``.

    Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty.
    Of equal texts the row with the smallest id stays; null ids come last; of rows with the same id one stays. An empty
    table gives an empty result. If ``df`` has the column ``ROW_ID``, it must be unique and fixed (a written table).
    """
    number = F.col(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()
    rows = digests(df.select(column(id).cast("long").alias("id"), column(text).alias("text"), number.alias("row"),
                             F.spark_partition_id().cast("long").alias("run")), "text").drop("text")
    rows = materialise(rows, "digests")
    kept = materialise(merge_runs(rows, task_count(df.sparkSession), fan_in), "digest-groups")
    found = look_up(rows.drop("run"), kept, KEY, "group_size")
    return found.select(F.col("id").alias(id), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"), F.col("row").alias(ROW_ID))


def drop_copies(df: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, with their own columns."""
    rows = materialise(df.select(packed(df), F.monotonically_increasing_id().alias(ROW_ID)), "dedup-rows")
    groups = exact_groups(rows.select(f"{ROW}.*", ROW_ID), id, text)
    stays = groups.filter("kept").select(ROW_ID)
    return unpacked(rows.join(stays, ROW_ID, "left_semi"))
