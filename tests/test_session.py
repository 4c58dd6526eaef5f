"""Scratch folders: a scope leaves nothing behind."""

import os

from lumenframe.operators import profile as pr
from lumenframe.plans import events, stored
from lumenframe.session import scratch_path, scratch_scope

SF = "/root/testdata/sf0.001"


def folders(spark):
    return set(os.listdir(os.path.dirname(scratch_path(spark, "x"))))


def test_a_scope_removes_what_was_made_in_it(spark, tmp_path):
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    before = folders(spark)
    with scratch_scope(spark) as made:
        found = stored.a12_stored_upsert(spark, SF).collect()
        events.g12_history_sort(spark, SF).write.parquet(f"{tmp_path}/out")
        with scratch_scope(spark) as inner:
            pr.profile_table(spark.range(50).selectExpr("id", "id % 3 AS k"))
        assert made and not set(inner) & set(made)
    assert found and folders(spark) == before
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0 and spark.read.parquet(kept).count() == 3
