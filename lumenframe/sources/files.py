"""CSV sources: validation, listing, encoding, separator, loading; CSV and JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Accepted kinds of files, their largest size and content types.
KINDS = {"csv": 50 * 1024 * 1024, "pdf": 20 * 1024 * 1024}
CONTENT_TYPES = {"csv": ["text/csv", "application/csv", "text/plain", "application/octet-stream"],
                 "pdf": ["application/pdf"]}
SEPARATORS = [",", ";", "\t", "|"]
FALLBACK_SEPARATOR = ","
REGULAR_SHARE = 0.9


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, type, size, modified)``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", file_name(F.col("path")).alias("name"),
                        F.when(suffix(F.col("path")) == "csv", "csv").otherwise("pdf").alias("type"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def validate_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``files`` (path, content_type) judged against what exists: ``ok`` and ``error`` per row."""
    kind = suffix(F.col("path"))
    limit, allowed = F.lit(None).cast("long"), F.lit(False)
    for k, size in KINDS.items():
        limit = F.when(kind == k, size).otherwise(limit)
        allowed = F.when(kind == k, F.col("content_type").isin(CONTENT_TYPES[k])).otherwise(allowed)
    sizes = listing.select("path", "size")
    error = (F.when(limit.isNull(), "unsupported suffix").when(F.col("size").isNull(), "file not found")
             .when(~F.coalesce(allowed, F.lit(False)), "unsupported content type").when(F.col("size") == 0, "file is empty")
             .when(F.col("size") > limit, "file too large"))
    return (files.join(sizes, "path", "left").withColumn("error", error)
            .withColumn("ok", F.col("error").isNull()))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select("value", F.col("_metadata.file_path").alias("path")))


def detect_encodings(spark: SparkSession, path: str, by=lambda p: p) -> DataFrame:
    """``(path, encoding)``: utf-8 where every line is valid, else latin-1, which never fails.

    The text source keeps raw bytes, so whole files are checked, in splits, without decoding.
    """
    return (_lines(spark, path).groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
            .groupBy(by(F.col("path")).alias("path"))
            .agg(F.when(F.bool_and("valid"), "utf-8").otherwise("latin-1").alias("encoding")))


def detect_separators(spark: SparkSession, path: str, by=lambda p: p) -> DataFrame:
    """``(path, separator)``: the candidate that occurs equally often in (nearly) all lines, else a comma."""
    # Plain steps over the bytes of a line: patterns would decode each line several times.
    bare = F.when(F.contains("value", F.lit('"')), F.regexp_replace("value", '"[^"]*"', "")).otherwise(F.col("value"))
    counts = [(F.octet_length("bare") - F.octet_length(F.replace("bare", F.lit(s), F.lit("")))).alias(f"n{i}")
              for i, s in enumerate(SEPARATORS)]
    # Equal lines meet as one row per task before anything is shuffled.
    shapes = (_lines(spark, path).filter(F.col("value") != "").select("path", bare.alias("bare"))
              .select("path", *counts).groupBy("path", "n0", "n1", "n2", "n3").agg(F.count(F.lit(1)).alias("lines")))
    spread = (shapes.select(by(F.col("path")).alias("path"), "lines",
                            F.posexplode(F.array("n0", "n1", "n2", "n3")).alias("i", "n"))
              .groupBy("path", "i", "n").agg(F.sum("lines").alias("lines")))
    usual = spread.groupBy("path", "i").agg(F.sum("lines").alias("total"),
                                            F.max_by(F.struct("n", "lines"), F.struct("lines", "n")).alias("top"))
    fits = (F.col("top.n") > 0) & (F.col("top.lines") >= REGULAR_SHARE * F.col("total"))
    order = F.struct((F.col("top.lines") / F.col("total")).alias("share"), F.col("top.n"), (-F.col("i")).alias("first"))
    best = usual.groupBy("path").agg(F.max(F.when(fits, order)).alias("best"))
    names = F.array(*[F.lit(s) for s in SEPARATORS])
    return best.select("path", F.coalesce(F.get(names, -F.col("best.first")), F.lit(FALLBACK_SEPARATOR)).alias("separator"))


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, separator: str | None = None,
             encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder of files with one header each. Give schema, separator and encoding to skip detection.

    Every file has its own separator and encoding. Files of one kind are read together, at most eight kinds, and joined by
    column name; without a schema, a column whose kinds differ in type becomes text.
    """
    def read(paths, sep, charset):
        reader = (spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line)
                  .option("recursiveFileLookup", "true").option("escape", '"')
                  .option("encoding", {"latin-1": "ISO-8859-1"}.get(charset, charset)))
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(paths)

    kinds = file_kinds(spark, path, separator, encoding)
    if len(kinds) < 2:
        (sep, charset), _ = kinds[0] if kinds else ((separator or FALLBACK_SEPARATOR, encoding or "utf-8"), [])
        return read(path, sep, charset)
    frames = [read(paths, sep, charset) for (sep, charset), paths in kinds]
    types: dict[str, set] = {}
    for f in frames:
        for c, t in f.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = {c for c, t in types.items() if len(t) > 1}
    shaped = [f.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in f.columns])
              for f in frames]
    joined = shaped[0]
    for f in shaped[1:]:
        joined = joined.unionByName(f, allowMissingColumns=True)
    return joined


def file_kinds(spark: SparkSession, path: str, separator: str | None = None,
               encoding: str | None = None) -> list[tuple[tuple[str, str], list[str]]]:
    """``((separator, encoding), paths)`` for each kind of file in a folder; the paths of a folder are its listing."""
    if separator and encoding:
        return [((separator, encoding), [path])]
    found = detect_encodings(spark, path).select("path", F.lit(encoding).alias("encoding") if encoding else "encoding")
    if separator:
        found = found.withColumn("separator", F.lit(separator))
    else:
        found = found.join(detect_separators(spark, path), "path", "left").withColumn(
            "separator", F.coalesce("separator", F.lit(FALLBACK_SEPARATOR)))
    rows = found.groupBy("separator", "encoding").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return sorted(((r["separator"], r["encoding"]), r["paths"]) for r in rows)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def capped(df: DataFrame, order: list[str], max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, status)``. No cap by default; with one, the first rows in ``order`` and a ``truncated`` flag."""
    status = row_count(df).withColumn("truncated", F.lit(False) if max_rows is None else F.col("rows") > max_rows)
    return (df if max_rows is None else df.orderBy(*order).limit(max_rows)), status


def write_csv(df: DataFrame, path: str) -> None:
    """Header, minimal quoting; a null becomes an empty quoted cell."""
    shaped = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    shaped.write.option("header", True).option("emptyValue", '""').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)
