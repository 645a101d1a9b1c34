"""Keyed topic source and sink for production deployments.

The Kafka connector is not on this machine's class path, so nothing here is
exercised by the tests; the streaming jobs are tested over the ordered file
source of ``streaming.harness`` instead, and take either source unchanged.
Per key, Kafka's order is the offset order within the key's partition, which
is what the processors assume of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topics(spark: SparkSession, bootstrap_servers: str, topics: list[str],
                max_offsets_per_trigger: int | None = None, starting_offsets: str = "earliest") -> DataFrame:
    """A1: topics read from the earliest offset; the caller sizes its
    micro-batches, there is no cap by default."""
    source = spark.readStream.format("kafka")
    if max_offsets_per_trigger is not None:
        source = source.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    raw = (source
           .option("kafka.bootstrap.servers", bootstrap_servers)
           .option("subscribe", ",".join(topics))
           .option("startingOffsets", starting_offsets)
           .option("failOnDataLoss", "true")
           .load())
    return raw.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                      "partition", "offset", F.col("timestamp").alias("ts"))


def write_topic(df: DataFrame, bootstrap_servers: str, topic: str, key_col: str, checkpoint: str):
    """Keyed sink; Kafka's partitioner places every record of a key in
    one partition. The checkpoint makes the write exactly-once per batch with
    an idempotent producer on the broker side."""
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return (df.select(F.col(key_col).cast("string").alias("key"), value.alias("value"))
            .writeStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("topic", topic)
            .option("checkpointLocation", checkpoint)
            .start())
