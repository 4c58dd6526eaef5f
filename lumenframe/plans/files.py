"""Registered queries of file sources and sinks: the given tables are written to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.plans.inputs import table, view
from lumenframe.session import scratch_path
from lumenframe.sources import files as fl

VARIANTS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}


def _rows(spark, sf):
    return view(spark, sf, "profile_input")


def _written(spark, sf):
    """The profile table as CSV, once per separator."""
    base = scratch_path(spark, "csv")
    for name, separator in VARIANTS.items():
        _rows(spark, sf).write.option("header", True).option("sep", separator).csv(f"{base}/{name}")
    return base


def a01_csv_load(spark, sf):
    """One folder with four separators and two encodings; one quarter of the rows for each separator."""
    base = scratch_path(spark, "csv")
    rows = _rows(spark, sf).withColumn("note", F.when(F.col("l_orderkey") % 2 == 0, "d\u00e9j\u00e0 vu").otherwise("plain"))
    for i, (name, separator) in enumerate(VARIANTS.items()):
        own = rows.filter(F.col("l_orderkey") % 4 == i)
        charset = "ISO-8859-1" if i == 2 else "UTF-8"
        own.write.option("header", True).option("sep", separator).option("encoding", charset).csv(f"{base}/{name}")
    loaded = fl.load_csv(spark, base)
    return loaded.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                         F.col("ship_text").cast("string").alias("ship_text"), "note")


def a02_encodings(spark, sf):
    base = scratch_path(spark, "encodings")
    texts = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[^\x20-\xff]+", " ").alias("text"))
    for name, charset in (("plain", "UTF-8"), ("western", "ISO-8859-1")):
        texts.write.option("header", True).option("encoding", charset).csv(f"{base}/{name}")
    return fl.detect_encodings(spark, base, fl.folder)


def a03_separators(spark, sf):
    return fl.detect_separators(spark, _written(spark, sf), fl.folder)


def a04_row_count(spark, sf):
    _, status = fl.capped(_rows(spark, sf), ["l_orderkey"], 1000)
    return status


def a05_validated_files(spark, sf):
    """Files of one folder beside names that do not exist or may not be loaded."""
    base = scratch_path(spark, "upload")
    table(spark, sf, "nation").write.partitionBy("n_regionkey").option("header", True).csv(base)
    listing = fl.list_files(spark, f"{base}/n_regionkey=*/*.csv")
    kind = F.lit("text/csv").alias("content_type")
    other = F.concat(F.lit(f"{base}/none/"), F.col("name")).alias("path")
    files = (listing.select("path", kind).unionByName(listing.select(other, kind))
             .unionByName(listing.select(F.concat("path", F.lit(".exe")).alias("path"), kind))
             .unionByName(listing.select("path", F.lit("image/png").alias("content_type"))))
    judged = fl.validate_files(files, listing)
    return judged.groupBy("ok", "error").agg(F.count_distinct(fl.folder(F.col("path"))).alias("folders"))


def a06_file_list(spark, sf):
    base = scratch_path(spark, "list")
    table(spark, sf, "customer").write.partitionBy("c_mktsegment").option("header", True).csv(base)
    found = fl.list_files(spark, f"{base}/c_mktsegment=*/*.csv")
    return found.groupBy("type").agg(F.count_distinct(fl.folder(F.col("path"))).alias("folders"),
                                     F.min(F.col("size") > 0).alias("all_filled"))


def a09_csv_export(spark, sf):
    base = scratch_path(spark, "export")
    fl.write_csv(_rows(spark, sf), base)
    back = spark.read.text(base).filter(~F.col("value").startswith("l_orderkey"))
    return back.groupBy("value").agg(F.count(F.lit(1)).alias("lines"))


def a10_json_export(spark, sf):
    base = scratch_path(spark, "export")
    fl.write_json(_rows(spark, sf), base)
    back = spark.read.schema("l_orderkey long, l_linenumber int, l_quantity double, l_discount double, "
                             "l_returnflag string").json(base)
    return back


SQL = {
    "a01_csv_load": """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, ship_text,
  CASE WHEN l_orderkey % 2 = 0 THEN 'd\u00e9j\u00e0 vu' ELSE 'plain' END AS note FROM profile_input""",
    "a02_encodings": """SELECT 'plain' AS path, 'utf-8' AS encoding FROM documents HAVING COUNT(*) > 0
UNION ALL SELECT 'western', CASE WHEN bool_or(regexp_matches(text, '[\\x{A0}-\\x{FF}]')) THEN 'latin-1' ELSE 'utf-8' END
FROM documents""",
    "a03_separators": """SELECT * FROM (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|'))
  v(path, separator)""",
    "a04_row_count": "SELECT COUNT(*) AS rows, COUNT(*) > 1000 AS truncated FROM profile_input",
    "a05_validated_files": """WITH f AS (SELECT COUNT(DISTINCT n_regionkey) AS n FROM nation)
SELECT true AS ok, CAST(NULL AS VARCHAR) AS error, n AS folders FROM f
UNION ALL SELECT false, 'file not found', 1 FROM f UNION ALL SELECT false, 'unsupported suffix', n FROM f
UNION ALL SELECT false, 'unsupported content type', n FROM f""",
    "a06_file_list": """SELECT 'csv' AS type, COUNT(DISTINCT c_mktsegment) AS folders, true AS all_filled FROM customer""",
    "a09_csv_export": """SELECT l_orderkey || ',' || l_linenumber || ',' || l_quantity || ',' || l_extendedprice || ','
  || coalesce(CAST(l_discount AS VARCHAR), '""') || ',' || l_tax || ',' || coalesce(l_returnflag, '""') || ','
  || l_linestatus || ',' || ship_text || ',' || constant_col AS value, COUNT(*) AS lines FROM profile_input GROUP BY 1""",
    "a10_json_export": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM profile_input",
}

QUERIES = [a01_csv_load, a02_encodings, a03_separators, a04_row_count, a05_validated_files, a06_file_list,
           a09_csv_export, a10_json_export]
