"""Writing a stream so that a restart or a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumenframe.operators.stored import StoredTable
from lumenframe.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def use_rocks(spark: SparkSession) -> None:
    """Keyed state on local disk with remote snapshots; needed for timers and time to live."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _run(stream: DataFrame, mode: str, base: str, transform: Callable[[DataFrame], DataFrame] | None, idle_batches: bool) -> None:
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(idle_batches).lower())
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).foreachBatch(write).start())
    spark.conf.set(setting, before)
    query.awaitTermination()


def _written(stream: DataFrame, base: str, transform: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    spark = stream.sparkSession
    fields = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    if transform is None:
        spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{base}/rows/epoch=-1")
        return spark.read.schema(fields).parquet(f"{base}/rows")
    return spark.read.parquet(f"{base}/rows")


def run_available(stream: DataFrame, mode: str = "update", label: str = "stream",
                  transform: Callable[[DataFrame], DataFrame] | None = None, idle_batches: bool = True) -> DataFrame:
    """Process what is there and return all written rows with their ``epoch``.

    Every micro-batch replaces its own folder, so a batch that runs twice is still written once. State that lives by
    the clock asks for batches without data for ever; ``idle_batches=False`` ends such a run with its data.
    """
    base = scratch_path(stream.sparkSession, label)
    _run(stream, mode, base, transform, idle_batches)
    return _written(stream, base, transform)


def run_in_steps(steps: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "update", label: str = "stream",
                 idle_batches: bool = True) -> DataFrame:
    """``run_available`` over a folder that grows: the rows of each step come as new files, of whatever number, and a run that
    goes on from the checkpoint of the one before takes them as its micro-batch."""
    spark = steps[0].sparkSession
    base = scratch_path(spark, label)
    for rows in steps:
        rows.write.mode("append").parquet(f"{base}/in")
        stream = build(read_stream(spark, f"{base}/in", rows.schema))
        _run(stream, mode, base, None, idle_batches)
    return _written(stream, base, None)


def merge_available(stream: DataFrame, table: StoredTable, fresh: Callable[[DataFrame], DataFrame],
                    combine: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, writer: str = "stream") -> int:
    """Merge what is there into a stored table, a micro-batch at a time; returns the number of batches that changed it.

    The table remembers the last batch of each writer, so a batch that comes again after a crash is left out.
    """
    changed = []

    def write(batch: DataFrame, epoch: int) -> None:
        rows = fresh(batch)
        if table.merge(rows, combine, writer, epoch):
            changed.append(epoch)

    (stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).foreachBatch(write).start().awaitTermination())
    return len(changed)


def latest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An update-mode result as a table: the last written row per key."""
    rest = [c for c in rows.columns if c not in keys and c != "epoch"]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_row"))
            .select(*keys, "_row.*"))
