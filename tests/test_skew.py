"""Joins with hot keys: the same rows, dealt over several tasks."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from emporia.operators import orders as O
from emporia.plans.skew import asof_join, heavy_keys, split_join, validity

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def lines(spark):
    """A third of all lines have one SKU."""
    return spark.range(9000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.concat(F.lit("O"), F.col("id") % 2000).alias("order_number"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 700)).alias("sku"),
        (F.col("id") % 7).cast("int").alias("qty"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 90).cast("int"))).alias("ts"))


def feed_of(spark):
    rows = [(v, T0 + dt.timedelta(days=30 * (v - 1)), f"S{i}", f"n{i}", f"{i}.{v}0", "c", "s") for i in range(600) for v in (1, 2, 3) if v == 1 or i % v]
    rows += [(v, T0 + dt.timedelta(days=10 * v), "HOT", "hot", f"7.{v}0", "c", "s") for v in range(1, 6)]
    return spark.createDataFrame(rows, "seq long, ts timestamp_ntz, sku string, name string, price string, color string, size string") \
        .withColumn("price", F.col("price").cast("decimal(18,2)"))


def test_only_hot_keys_are_heavy(lines):
    assert heavy_keys(lines, "sku", 64) == {"HOT": 22}
    assert heavy_keys(lines.where("sku <> 'HOT'"), "sku", 64) == {}
    assert heavy_keys(lines.limit(0), "sku", 64) == {}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_equals_the_plain_join(spark, lines, how):
    one = spark.createDataFrame([("HOT", 1), ("S1", 2), ("S2", 3), (None, 4)], "sku string, x int")
    rows = lines.unionByName(lines.limit(3).withColumn("sku", F.lit(None).cast("string")))
    got = split_join(rows, one, "sku", {"HOT": 8}, how)
    assert got.columns == [*rows.columns, "x"]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(one, "sku", how).select(*rows.columns, "x").collect()))


def test_the_hot_key_is_split_without_broadcast(spark, lines):
    """One third of the rows would meet in one task; no task gets a tenth."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        heavy = heavy_keys(lines, "sku", 64)
        def largest(h):
            j = split_join(lines, O.first_seen(feed_of(spark)), "sku", h).withColumn("p", F.spark_partition_id())
            return max(r.n for r in j.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("known_from")).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert largest({}) >= 3000
        assert largest(heavy) < 900
        assert "_salt" in split_join(lines, O.first_seen(feed_of(spark)), "sku", heavy)._jdf.queryExecution().toString()
    finally:
        for key, value in (("autoBroadcastJoinThreshold", "10485760"), ("adaptive.enabled", "true"), ("shuffle.partitions", "4")):
            spark.conf.set(f"spark.sql.{key}", value)


@pytest.mark.parametrize("heavy", [{}, {"HOT": 5, "S3": 2}])
def test_lines_are_priced_as_of_their_placement(spark, lines, heavy):
    feed = feed_of(spark)
    versions = sorted((r.sku, r.ts, r.seq, r.price) for r in feed.collect())
    want = {}
    for r in lines.collect():
        held = [p for sku, ts, _, p in versions if sku == r.sku and ts <= r.ts]
        want[r.l_orderkey] = held[-1] if held else None
    got = O.price_lines(lines, feed, heavy).collect()
    assert {r.l_orderkey: r.price for r in got} == want and len(got) == 9000
    assert all(r.found == (r.price is not None) for r in got)
    assert None in want.values() and len({p for k, p in want.items() if k % 3 == 0}) == 6


def test_versions_of_one_instant_leave_the_last(spark):
    v = spark.createDataFrame([("A", T0, 1, "x"), ("A", T0, 2, "y"), ("A", T0 + dt.timedelta(1), 3, "z")], "sku string, ts timestamp_ntz, seq long, n string")
    rows = spark.createDataFrame([("A", T0 + dt.timedelta(hours=h)) for h in (-1, 0, 23, 24)] + [(None, T0)], "sku string, at timestamp_ntz")
    got = asof_join(rows, validity(v, "sku", "ts", ["seq"]).drop("ts", "seq"), "sku", "at", {})
    assert sorted((str(r.sku), r.at, r.n) for r in got.collect()) == sorted([("A", T0 - dt.timedelta(hours=1), None), ("A", T0, "y"),
        ("A", T0 + dt.timedelta(hours=23), "y"), ("A", T0 + dt.timedelta(hours=24), "z"), ("None", T0, None)], key=lambda x: x[:2])


def test_orders_with_a_product_not_yet_known_are_not_saved(spark):
    feed = feed_of(spark)
    lines = spark.createDataFrame([("o1", "S1", T0, 1), ("o2", "HOT", T0, 1), ("o2", "S1", T0, 2), ("o3", "NO", T0, 1), ("o4", "HOT", T0 + dt.timedelta(10), 1)],
                                  "order_number string, sku string, ts timestamp_ntz, l_linenumber int")
    placed = spark.createDataFrame([(f"o{i}", T0) for i in range(1, 6)], "order_number string, ts timestamp_ntz")
    assert sorted(r.order_number for r in O.saved_orders(placed, lines, feed).collect()) == ["o1", "o4", "o5"]
