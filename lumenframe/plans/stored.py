"""Registered queries over stored tables: each builds a table in the shared folder, changes it there and reads it back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lumenframe.operators import documents as dc, events as ev, privacy as pv
from lumenframe.operators.stored import StoredTable
from lumenframe.operators.vector_index import VectorIndex
from lumenframe.plans import documents as documents_plans, events as event_plans, privacy as privacy_plans
from lumenframe.plans.inputs import VIEWS, table, view
from lumenframe.plans.shape import rounded
from lumenframe.session import scratch_path
from lumenframe.streaming import sink


def _rollup_table(spark, rows):
    return StoredTable(spark, scratch_path(spark, "stored-rollup"), rows.schema, ["summary_date"])


def a12_stored_upsert(spark, sf):
    """The log in three parts, merged day by day into a stored rollup; the second part comes twice."""
    events = view(spark, sf, "analytics_events")
    parts = [ev.daily_rollup(events.filter(F.col("id") % 3 == i)) for i in range(3)]
    stored = _rollup_table(spark, parts[0])
    for epoch, i in enumerate([0, 1, 1, 2]):
        stored.merge(parts[i], ev.merge_rollups, "upload", min(epoch, i))
    return event_plans.rollup_out(stored.read())


def g02_stored_rebuild(spark, sf):
    """A rollup of two thirds of the log, of which the last ten days are rebuilt from all of it."""
    events = view(spark, sf, "analytics_events")
    old = ev.daily_rollup(events.filter(F.col("id") % 3 != 0))
    stored = _rollup_table(spark, old)
    stored.append(old)
    stored.overwrite_partitions(ev.rolling_rollup(events, days=10))
    return event_plans.rollup_out(stored.read())


def g03_stored_stream(spark, sf):
    """The log as a stream in three steps, each with events of all days, merged into a stored rollup batch by batch; then the
    stream runs once more without its checkpoint, which changes nothing."""
    events = table(spark, sf, "events")
    folder = scratch_path(spark, "event-files")
    stored = _rollup_table(spark, ev.daily_rollup(view(spark, sf, "analytics_events")))
    checkpoint = scratch_path(spark, "checkpoint")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).write.mode("append").parquet(folder)
        stream = spark.sql(VIEWS["analytics_events"], events=sink.read_stream(spark, folder, events.schema))
        sink.merge_available(stream, stored, ev.daily_rollup, ev.merge_rollups, checkpoint)
    sink.merge_available(stream, stored, ev.daily_rollup, ev.merge_rollups, scratch_path(spark, "checkpoint"))
    return event_plans.rollup_out(stored.read())


def _chunk_table(spark, sf):
    chunks = dc.first_writers(documents_plans._chunks(spark, sf), documents_plans.ORDER)
    stored = StoredTable(spark, scratch_path(spark, "stored-chunks"), chunks.schema, ["source"])
    stored.append(chunks)
    return stored


def a13_stored_delete(spark, sf):
    """One source and a part of another go from the stored chunks."""
    stored = _chunk_table(spark, sf)
    stored.delete((F.col("source") == "src3") | ((F.col("source") == "src5") & (F.col("doc_id") % 2 == 0)))
    return stored.read().groupBy("source").agg(F.count(F.lit(1)).alias("chunks"),
                                               F.count_distinct("chunk_id").alias("distinct_chunks"))


def f12_stored_reindex(spark, sf):
    """A source is dropped and put in anew in one change; chunks that another source holds already are left out."""
    stored = _chunk_table(spark, sf)
    fresh = documents_plans._chunks(spark, sf).filter(F.col("source") == "src3")
    left = stored.read().filter(F.col("source") != "src3")
    stored.delete(F.col("source") == "src3", then=dc.insert_absent(left, fresh, documents_plans.ORDER))
    return stored.read().select("chunk_id", "source")


def _token_table(spark, sf):
    tokens = view(spark, sf, "refresh_tokens").withColumn("created_month", F.date_format("created_at", "yyyy-MM"))
    stored = StoredTable(spark, scratch_path(spark, "stored-tokens"), tokens.schema, ["created_month"])
    stored.append(tokens)
    return stored


def h09_stored_erasure(spark, sf):
    """The stored tokens without those of erased users."""
    stored = _token_table(spark, sf)
    stored.delete_matching(privacy_plans._erased(spark, sf).select(F.col("id").alias("user_id")), ["user_id"])
    return stored.read().select("id", "user_id")


def h11_stored_purge(spark, sf):
    """The stored tokens after the retention purge."""
    stored = _token_table(spark, sf)
    end = ev.latest_time(view(spark, sf, "refresh_tokens"), "created_at")
    stored.delete(pv.purge_condition(end - dt.timedelta(days=300)))
    return stored.read().select("id", "user_id")


def _index(spark, sf):
    """An index of three quarters of the vectors, in small cells."""
    vectors = view(spark, sf, "vectors")
    index = VectorIndex(spark, scratch_path(spark, "stored-index"), vectors.schema, 64, cell_rows=40)
    index.create(vectors.filter(F.col("id") % 4 != 0), cells=6)
    return index, vectors


def f09_stored_index(spark, sf):
    """The last quarter is inserted in two batches, one of which comes twice; every tenth vector goes, some of these come back;
    large cells are split. With every cell probed the search equals an exact one over what is left."""
    index, vectors = _index(spark, sf)
    for part, epoch in ((0, 0), (4, 1), (4, 1)):
        index.insert(vectors.filter(F.col("id") % 8 == part), "loader", epoch)
    index.delete_where(F.col("id") % 10 == 3)
    index.split()
    index.insert(vectors.filter(F.col("id") % 20 == 3))
    index.compact()
    questions = vectors.filter(F.col("id") % 50 == 0)
    found = index.search(questions, 5, probes=len(index.centres().rows))
    return found.select("query_id", "id", "position", rounded("similarity"))


def f09_stored_recall(spark, sf):
    """Recall of the default search before any change and after inserts, deletes and splits."""
    index, vectors = _index(spark, sf)
    questions = vectors.filter(F.col("id") % 50 == 0)
    before = index.recall(questions).select(F.lit("before").alias("stage"), "expected", "recall")
    before = spark.createDataFrame(before.collect(), before.schema)  # one row, of the index as it is now
    index.insert(vectors.filter(F.col("id") % 4 == 0))
    index.delete_where(F.col("id") % 10 == 3)
    index.split()
    return before.unionByName(index.recall(questions).select(F.lit("after").alias("stage"), "expected", "recall"))


SQL = {
    "f09_stored_index": f"""WITH {documents_plans._SIM}, found AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id
  ORDER BY similarity DESC, id) AS INTEGER) AS position FROM sim WHERE id % 10 <> 3 OR id % 20 = 3)
SELECT query_id, id, position, ROUND(similarity, 4) AS similarity FROM found WHERE position <= 5""",
    "a12_stored_upsert": event_plans.SQL["a12_upsert_rollup"],
    "g02_stored_rebuild": f"""WITH r AS ({event_plans.ROLLUP_SQL}), o AS ({event_plans.ROLLUP_SQL.replace(
        'FROM analytics_events', 'FROM analytics_events WHERE id % 3 <> 0')}),
t AS (SELECT * FROM r WHERE summary_date >= (SELECT MAX(summary_date) FROM r) - INTERVAL 10 DAY
  UNION ALL SELECT * FROM o WHERE summary_date < (SELECT MAX(summary_date) FROM r) - INTERVAL 10 DAY)
{event_plans.ROLLUP_OUT} FROM t""",
    "g03_stored_stream": event_plans.SQL["g01_daily_rollup"],
    "a13_stored_delete": f"""WITH {documents_plans._CHUNKS}, {documents_plans._FIRST} SELECT source, COUNT(*) AS chunks,
  COUNT(DISTINCT chunk_id) AS distinct_chunks FROM first
WHERE source <> 'src3' AND NOT (source = 'src5' AND doc_id % 2 = 0) GROUP BY 1""",
    "f12_stored_reindex": documents_plans.SQL["f12_reindex_source"],
    "h09_stored_erasure": privacy_plans.SQL["h09_remaining_tokens"],
    "h11_stored_purge": """WITH n AS (SELECT MAX(created_at) - INTERVAL 300 DAY AS t FROM refresh_tokens)
SELECT id, user_id FROM refresh_tokens, n
WHERE NOT (expires_at < t - INTERVAL 7 DAY OR (revoked AND created_at < t - INTERVAL 30 DAY))""",
}

QUERIES = [a12_stored_upsert, g02_stored_rebuild, g03_stored_stream, a13_stored_delete, f12_stored_reindex,
           h09_stored_erasure, h11_stored_purge, f09_stored_index, f09_stored_recall]
