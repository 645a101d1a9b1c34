"""Keyed sinks (A6) and keyed table upsert."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..session import default_partitions, written


def write_keyed(df: DataFrame, key: str, path: str, buckets: int | None = None) -> None:
    """Keyed sink; the key decides the partition (as a topic partitioner
    would): each key's rows land in the directory of its hash bucket, so a
    reader of one key scans one bucket. Rows are rebalanced by bucket: adaptive
    execution joins small buckets and splits a large one, whatever key fills
    it, so a hot key is written by several tasks into one directory. No pass
    over the rows samples bounds first."""
    n = buckets or default_partitions(df.sparkSession)
    b = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    (df.withColumn("bucket", b).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def create_table(df: DataFrame, key: str, path: str, buckets: int | None = None) -> None:
    """A table for :func:`upsert_latest`: one folder per hash bucket of the key.
    The number of buckets and the columns are kept with the table."""
    spark, n = df.sparkSession, buckets or default_partitions(df.sparkSession)
    write_keyed(df, key, f"{path}/rows", n)
    spark.createDataFrame([(n, df.schema.json())], "buckets int, schema string").write.mode("overwrite").parquet(f"{path}/meta")


def _table(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    meta = spark.read.parquet(f"{path}/meta").first()
    schema = StructType.fromJson(json.loads(meta.schema)).add("bucket", IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows"), meta.buckets


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path)[0].drop("bucket")


def upsert_latest(spark: SparkSession, path: str, batch: DataFrame, key: str, seq: str) -> None:
    """Keyed upsert of one batch: per key the row with the highest ``seq``
    wins, whether it is in the table or in the batch, so a late old row changes
    nothing and a replayed batch neither.

    Only the buckets that hold a key of the batch are read, merged (partial
    ``max_by``) and written again; the files of all others stay untouched. The
    merged rows are written aside first, so a failed job leaves the table as it
    was and can be run again.
    """
    table, n = _table(spark, path)
    columns = [c for c in table.columns if c != "bucket"]
    batch = written(batch.select(*columns).withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")), "upsert-batch")
    touched = [r.bucket for r in batch.select("bucket").distinct().collect()]      # at most the number of buckets
    if not touched:
        return
    both = batch.unionByName(table.where(F.col("bucket").isin(touched)).select(*columns, "bucket"))
    rest = [c for c in columns if c != key]
    merged = written(both.groupBy("bucket", key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
                     .select("bucket", key, "r.*").select(*columns, "bucket"), "upsert-merged")
    (merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(f"{path}/rows"))
    spark.catalog.refreshByPath(f"{path}/rows")


def upsert_sink(path: str, key: str, seq: str):
    """A7 as a stream sink: for ``writeStream.foreachBatch``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(batch.sparkSession, path, batch, key, seq)
    return sink
