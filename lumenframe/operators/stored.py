"""Tables on shared storage that are really updated: partitions replaced, rows merged or deleted, old readers undisturbed.

A table is a folder of data files and of numbered manifests. A manifest lists the files of a version with their partition and
rows, and for each writer the last batch it has written. Changes write new files first; then a manifest, built aside, takes
the next number by one rename. Readers take the newest manifest, so they see all of a change or nothing of it, and a batch that
comes again changes nothing. Files that a change doesn't touch keep their names.

The folder needs a file system whose rename is atomic and refuses a name that exists (HDFS, local). Of two writers that build on
the same version one is refused.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MANIFEST = "kind string, name string, part string, amount long"


class Conflict(RuntimeError):
    """Another writer has committed since this one has read."""


class StoredTable:
    """``partition``: columns whose values part the files. ``schema``: that of the rows (a frame's ``schema``)."""

    def __init__(self, spark: SparkSession, path: str, schema, partition: list[str]):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, list(partition)

    # Versions --------------------------------------------------------------------------------------------------

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """Number of the newest version; -1 where nothing is stored."""
        fs, folder = self._fs(), self._path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), default=-1)

    def manifest(self, version: int | None = None) -> list:
        version = self.version() if version is None else version
        if version < 0:
            return []
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v{version:08d}").collect()

    def files(self, version: int | None = None) -> list:
        """Rows (name, part, amount) of the version's files; amount is the number of their rows."""
        return [r for r in self.manifest(version) if r["kind"] == "file"]

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows([r["name"] for r in self.files(version)])

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*names)

    def _part(self) -> Column:
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("__none__")) for c in self.partition])

    def _write(self, rows: DataFrame) -> list[tuple]:
        """New files, each of one partition: (file, name, part, rows)."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (rows.select(*[f.name for f in self.schema]).withColumn("_part", self._part())
         .write.partitionBy("_part").parquet(folder))
        if not self._fs().globStatus(self._path(f"{folder}/_part=*")):
            return []
        written = self.spark.read.schema(_with_part(self.schema)).parquet(folder)
        found = written.groupBy(F.col("_metadata.file_path").alias("name"), "_part").agg(F.count(F.lit(1)).alias("n")).collect()
        return [("file", unquote(r["name"]), r["_part"], r["n"]) for r in found]

    def _commit(self, base: int, files: list[tuple], writers: dict[str, int]) -> int:
        rows = files + [("writer", name, None, epoch) for name, epoch in writers.items()]
        aside = f"{self.path}/manifests/aside-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(aside)
        fs, target = self._fs(), self._path(f"{self.path}/manifests/v{base + 1:08d}")
        if fs.exists(target) or not fs.rename(self._path(aside), target):
            raise Conflict(f"version {base + 1} of {self.path} exists already")
        return base + 1

    def _state(self) -> tuple[int, list[tuple], dict[str, int]]:
        version = self.version()
        rows = self.manifest(version)
        return (version, [tuple(r) for r in rows if r["kind"] == "file"],
                {r["name"]: r["amount"] for r in rows if r["kind"] == "writer"})

    def _change(self, writer: str | None, epoch: int | None, build: Callable[[list[tuple]], list[tuple]]) -> bool:
        """Whether the change was made: a batch that its writer has written already is left out."""
        base, files, writers = self._state()
        if writer is not None and writers.get(writer, -1) >= epoch:
            return False
        after = build(files)
        self._commit(base, after, writers | ({writer: epoch} if writer is not None else {}))
        return True

    # Changes ---------------------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, writer: str | None = None, epoch: int | None = None) -> bool:
        return self._change(writer, epoch, lambda files: files + self._write(rows))

    def overwrite_partitions(self, rows: DataFrame, writer: str | None = None, epoch: int | None = None) -> bool:
        """Partitions that occur in ``rows`` are replaced by them; all others stay."""
        def build(files):
            new = self._write(rows)
            parts = {f[2] for f in new}
            return [f for f in files if f[2] not in parts] + new
        return self._change(writer, epoch, build)

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None,
              epoch: int | None = None) -> bool:
        """Upsert: the partitions that occur in ``rows`` are read, combined with them and replaced."""
        def build(files):
            parts = {r[0] for r in rows.select(self._part()).distinct().collect()}  # one value per partition
            old = [f for f in files if f[2] in parts]
            new = self._write(combine(self._rows([f[1] for f in old]), rows))
            return [f for f in files if f[2] not in parts] + new
        return self._change(writer, epoch, build)

    def _files_of(self, hits: DataFrame) -> dict[str, int]:
        """Rows of ``hits`` (of ``read``) by the file that holds them."""
        per = hits.groupBy("_file").agg(F.count(F.lit(1)).alias("hits")).collect()
        return {unquote(r["_file"]): r["hits"] for r in per}

    def rewrite(self, hits: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame],
                then: DataFrame | None = None, keep_whole: bool = True) -> dict:
        """Copy on write: only files that hold a row of ``hits(rows)`` are read again and replaced by ``change(rows)``.

        ``keep_whole=False``: the change drops all hits, so a file of hits alone is not even read. ``then`` is appended in the
        same version."""
        base, files, writers = self._state()
        found = self._files_of(hits(self.read(base).withColumn("_file", F.col("_metadata.file_path")))) if files else {}
        touched = [f for f in files if f[1] in found]
        again = [f[1] for f in touched if keep_whole or f[3] > found[f[1]]]
        new = self._write(change(self._rows(again))) if again else []
        added = self._write(then) if then is not None else []
        if touched or added:
            self._commit(base, [f for f in files if f[1] not in found] + new + added, writers)
        return {"hits": sum(found.values()), "rows_before": sum(f[3] for f in files), "files_touched": len(touched),
                "files_kept": len(files) - len(touched)}

    def delete(self, condition: Column, then: DataFrame | None = None) -> dict:
        """Rows for which the condition holds go; unknown counts as no."""
        hit = F.coalesce(condition, F.lit(False))
        return self.rewrite(lambda rows: rows.filter(hit), lambda rows: rows.filter(~hit), then, keep_whole=False)

    def delete_matching(self, keys: DataFrame, on: list[str]) -> dict:
        """Rows whose ``on`` columns occur in ``keys`` go."""
        keys = keys.select(*on).distinct()
        return self.rewrite(lambda rows: rows.join(keys, on, "left_semi"), lambda rows: rows.join(keys, on, "left_anti"),
                            keep_whole=False)

    def drop_unlisted(self, keep: int = 1) -> int:
        """Remove data files that none of the newest ``keep`` versions lists, and older manifests. Returns the files removed.
        Not to be run beside a writer."""
        newest = self.version()
        live = {_plain(r["name"]) for v in range(max(0, newest - keep + 1), newest + 1) for r in self.files(v)}
        fs, gone = self._fs(), 0
        walk = fs.listFiles(self._path(f"{self.path}/data"), True)
        while walk.hasNext():
            path = walk.next().getPath()
            if path.getName().startswith("part-") and _plain(unquote(path.toUri().toString())) not in live:
                fs.delete(path, False)
                gone += 1
        for v in range(newest - keep + 1):
            fs.delete(self._path(f"{self.path}/manifests/v{v:08d}"), True)
        return gone


def _plain(name: str) -> str:
    return re.sub(r"^file:/+", "file:/", name)


def _with_part(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_part", T.StringType())])
