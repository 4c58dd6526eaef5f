"""Stored tables: what readers see, which files stay, repeated and half-written batches; SQL over the stored files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import events as ev
from lumenframe.operators.stored import Conflict, StoredTable
from lumenframe.plans.inputs import view
from lumenframe.streaming import sink

SF = "/root/testdata/sf0.001"


def made(spark, path, n=600):
    rows = spark.range(n).select("id", (F.col("id") % 5).cast("string").alias("source"), (F.col("id") * 2).alias("v"))
    stored = StoredTable(spark, str(path), rows.schema, ["source"])
    stored.append(rows.repartition(3))
    return stored, rows


def names(stored, version=None):
    return {r["name"] for r in stored.files(version)}


def by_sql(stored, sql):
    """``sql`` over the files that the newest version lists, read by another engine."""
    files = [r["name"].replace("file://", "") for r in stored.files()]
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW t AS SELECT * FROM read_parquet({files}, hive_partitioning = false)")
    return duckdb.sql(sql).fetchall()


def test_delete_touches_only_files_with_hits(spark, tmp_path):
    stored, rows = made(spark, tmp_path)
    before = stored.files()
    counts = stored.delete((F.col("source") == "3") & (F.col("id") < 300))
    assert counts == {"hits": 60, "rows_before": 600, "files_touched": 3, "files_kept": len(before) - 3}
    assert {r["name"] for r in before if r["part"] != "3"} <= names(stored)
    assert not {r["name"] for r in before if r["part"] == "3"} & names(stored)
    want = [(i, str(i % 5), 2 * i) for i in range(600) if not (i % 5 == 3 and i < 300)]
    assert by_sql(stored, "SELECT id, source, v FROM t ORDER BY id") == want
    assert stored.read(0).count() == 600  # readers of the version before
    assert sum(r["amount"] for r in stored.files()) == len(want)
    nothing = stored.delete(F.col("id") > 10_000)
    assert nothing["files_touched"] == 0 and stored.version() == 1
    whole = stored.delete(F.col("source") == "4")
    assert whole["hits"] == 120 and not [r for r in stored.files() if r["part"] == "4"]


def test_unknown_conditions_keep_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id long, source string")
    stored = StoredTable(spark, str(tmp_path), rows.schema, ["source"])
    stored.append(rows)
    stored.delete(F.col("source") == "a")
    assert sorted(r["id"] for r in stored.read().collect()) == [1, 3]
    stored.delete_matching(spark.createDataFrame([(3,), (3,), (None,)], "id long"), ["id"])
    assert [r["id"] for r in stored.read().collect()] == [1]


def test_rewrite_changes_rows_in_place(spark, tmp_path):
    stored, _ = made(spark, tmp_path)
    before = names(stored)
    hit = (F.col("id") == 7) & (F.col("source") == "2")
    counts = stored.rewrite(lambda rows: rows.filter(hit), lambda rows: rows.withColumn("v", F.when(hit, -1).otherwise(F.col("v"))))
    assert counts["files_touched"] == 1 and len(names(stored) & before) == len(before) - 1
    assert by_sql(stored, "SELECT count(*), sum(v), count(*) FILTER (v = -1) FROM t") == [(600, 600 * 599 - 14 - 1, 1)]


def test_partitions_are_replaced(spark, tmp_path):
    stored, rows = made(spark, tmp_path)
    old = {r["part"]: r["name"] for r in stored.files()}
    stored.overwrite_partitions(spark.createDataFrame([(1, "2", 0), (2, "new", 0)], rows.schema))
    got = by_sql(stored, "SELECT source, count(*) FROM t GROUP BY 1 ORDER BY 1")
    assert got == [("0", 120), ("1", 120), ("2", 1), ("3", 120), ("4", 120), ("new", 1)]
    assert {old[p] for p in "0134"} <= names(stored)


def test_half_written_batches_are_not_seen(spark, tmp_path, monkeypatch):
    stored, rows = made(spark, tmp_path)

    def broken(*_):
        raise OSError("lost")
    with monkeypatch.context() as patched:
        patched.setattr(StoredTable, "_commit", broken)
        with pytest.raises(OSError):
            stored.append(rows, "w", 0)
    spark.createDataFrame([("file", "x", "y", 1)], "kind string, name string, part string, amount long").write.parquet(
        f"{tmp_path}/manifests/aside-1")
    assert stored.version() == 0 and stored.read().count() == 600
    assert stored.append(rows, "w", 0) and not stored.append(rows, "w", 0)
    assert stored.append(rows, "other", 0) and stored.read().count() == 1800
    lost = 5 * rows.rdd.getNumPartitions()
    assert stored.drop_unlisted() == lost and stored.read().count() == 1800 and stored.version() == 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    stored, rows = made(spark, tmp_path)
    base, files, writers = stored._state()
    stored.append(rows)
    with pytest.raises(Conflict):
        stored._commit(base, files, writers)
    assert stored.read().count() == 1200


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, source string")
    stored = StoredTable(spark, str(tmp_path), rows.schema, ["source"])
    assert stored.read().count() == 0 and stored.delete(F.lit(True))["hits"] == 0
    stored.append(rows)
    assert stored.read().count() == 0 and stored.version() == 0


def test_three_micro_batches_equal_the_batch_rollup(spark, tmp_path):
    """Files of mixed days, so that late rows change days stored before; a batch that comes again changes nothing."""
    events = view(spark, SF, "analytics_events")
    for i in range(3):
        events.filter(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    fresh = ev.daily_rollup(events)
    stored = StoredTable(spark, f"{tmp_path}/rollup", fresh.schema, ["summary_date"])
    run = lambda checkpoint: sink.merge_available(
        sink.read_stream(spark, f"{tmp_path}/in", events.schema, files_per_batch=1), stored, ev.daily_rollup, ev.merge_rollups,
        f"{tmp_path}/{checkpoint}")
    assert run("one") == 3 and stored.version() == 2

    def rows(df):
        return sorted((str(r["summary_date"]), r["event_type"], r["total_count"], r["success_count"], r["duration_count"],
                       round(r["duration_sum"], 6)) for r in df.collect())
    assert rows(stored.read()) == rows(fresh)
    assert run("lost") == 0 and rows(stored.read()) == rows(fresh)  # the checkpoint is gone, all batches come again
