"""Running a streaming job to completion over a file source.

Production source is a keyed topic (``readStream.format("kafka")``, per-key
order = offset order). No Kafka connector jar exists here, so the same jobs
read a Parquet file stream: the input is written once, by all tasks in
parallel, into one folder per time slice. A slice is published to the source
by renaming its folder, and one ``Trigger.AvailableNow`` run on the stream's
checkpoint drains it before the next one is published, so micro-batches follow
event order (a fold's result depends on it) however many files a slice has.

Sink: ``foreachBatch`` writing each micro-batch to ``batch_id=<n>`` with
overwrite, so a batch replayed after a failure replaces its own output
(exactly-once end to end with the checkpoint, J8). Everything lives under the
session's shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def _number(df: DataFrame, col: str) -> Column:
    kind = dict(df.dtypes)[col]
    return F.unix_micros(F.col(col).cast("timestamp")) if kind.startswith("timestamp") else F.col(col).cast("bigint")


class Staged:
    """A table dealt into time slices that a file stream reads one by one."""

    def __init__(self, df: DataFrame, name: str, col: str = "ts", slices: int = 4, times: DataFrame | None = None):
        """Rows with equal ``col`` share a slice; a later slice has later rows.
        Where a slice begins is looked up in ``times`` (by default ``df``, which is
        then computed twice): a cheaper table whose ``col`` is spread like that of
        ``df``. How even the slices are depends on it, their order does not."""
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = scratch_path(self.spark, f"{name}-in")
        at = _number(df, col)
        probs = [i / slices for i in range(1, slices)]
        times = df if times is None else times
        bounds = times.agg(F.percentile_approx(_number(times, col), probs, 1000)).first()[0] if probs else []
        slice_of = sum((F.when(at > F.lit(b), 1).otherwise(0) for b in sorted(set(bounds or []))), F.lit(0))
        df.withColumn("_slice", slice_of.cast("int")).write.partitionBy("_slice").parquet(f"{self.path}/waiting")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(f"{self.path}/ready"))
        self.waiting = sorted(p.getPath().getName() for p in self._fs.listStatus(path(f"{self.path}/waiting")) if p.isDirectory())

    def publish(self) -> bool:
        """Hand the next slice to the source; False when there is none left."""
        if not self.waiting:
            return False
        name = self.waiting.pop(0)
        self._fs.rename(self._path(f"{self.path}/waiting/{name}"), self._path(f"{self.path}/ready/{name.replace('=', '')}"))
        return True

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/ready/*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ensure_rocksdb(spark: SparkSession) -> None:
    """State API v2 (``transformWithState``) needs the RocksDB state store;
    set it for this session's new streams when nothing is configured."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or "HDFSBackedStateStoreProvider" in current:
        spark.conf.set(key, ROCKSDB)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
             on_written: Callable[[int], None] | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Drain what the source has into the table of batches at ``out`` (or into
    ``sink``); ``on_written`` is called after a batch is written, before it is
    committed."""
    ensure_rocksdb(stream.sparkSession)

    def batches(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if on_written is not None:
            on_written(batch_id)

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink or batches)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def drain(staged: Staged | list[Staged], transform: Callable[..., DataFrame], name: str, mode: str = "append",
          checkpoint: str | None = None, out: str | None = None, on_written: Callable[[int], None] | None = None) -> DataFrame:
    """Run ``transform`` of the staged stream(s) to the end, one run per slice
    on one checkpoint; the sink's table."""
    sources = staged if isinstance(staged, list) else [staged]
    spark = sources[0].spark
    out, checkpoint = out or scratch_path(spark, f"{name}-out"), checkpoint or scratch_path(spark, f"{name}-ckpt")
    schema = None
    while any([s.publish() for s in sources]) or schema is None:
        stream = transform(*[s.stream() for s in sources])
        schema = stream.schema
        run_once(stream, out, checkpoint, mode, on_written)
    return read_output(spark, out, schema)


def read_output(spark: SparkSession, out: str, schema) -> DataFrame:
    """The batches written so far; empty only if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.listStatus(path):
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("batch_id", F.lit(None).cast("bigint"))
    return spark.read.parquet(out)


def latest_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode output: the row of the last batch per key."""
    rest = [c for c in table.columns if c not in keys and c != "batch_id"]
    return (table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("r"))
            .select(*keys, "r.*"))
