"""Keyed table: latest row wins, only touched buckets are written."""
import os

import pytest
from pyspark.sql import functions as F

from emporia.operators import catalog as K
from emporia.operators import users as U
from emporia.session import scratch_path, session_conf
from emporia.sources import sinks as SK

ROW = "sku string, seq long, name string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROW)


@pytest.fixture
def path(spark):
    path = scratch_path(spark, "t-upsert")
    SK.create_table(spark.range(400).select(F.concat(F.lit("S"), "id").alias("sku"), F.lit(5).cast("long").alias("seq"), F.lit("old").alias("name")),
                    "sku", path, buckets=16)
    return path


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


def test_older_late_rows_do_not_win_and_replays_change_nothing(spark, path):
    batch = rows(spark, ("S1", 4, "late"), ("S2", 6, "new"), ("S2", 7, "newer"), ("X", 1, "first"))
    for _ in range(2):
        SK.upsert_latest(spark, path, batch, "sku", "seq")
        got = {r.sku: (r.seq, r.name) for r in SK.read_table(spark, path).collect()}
        assert len(got) == 401 == SK.read_table(spark, path).count()
        assert (got["S1"], got["S2"], got["X"], got["S3"]) == ((5, "old"), (7, "newer"), (1, "first"), (5, "old"))


def test_untouched_buckets_keep_their_files(spark, path):
    before = files(path)
    SK.upsert_latest(spark, path, rows(spark, ("S1", 9, "new")), "sku", "seq")
    after = files(path)
    changed = {f.split("bucket=")[1].split("/")[0] for f in before ^ after}
    assert len(changed) == 1 and len(before & after) >= len(before) - 4
    SK.upsert_latest(spark, path, rows(spark), "sku", "seq")
    assert files(path) == after


def test_an_empty_table_takes_a_first_batch(spark):
    path = scratch_path(spark, "t-empty")
    SK.create_table(rows(spark), "sku", path, buckets=4)
    assert SK.read_table(spark, path).count() == 0
    SK.upsert_latest(spark, path, rows(spark, ("A", 1, "a"), (None, 2, "none")), "sku", "seq")
    assert sorted(map(str, SK.read_table(spark, path).collect())) == sorted(map(str, rows(spark, ("A", 1, "a"), (None, 2, "none")).collect()))


def test_settings_are_put_back(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), session_conf(spark, {key: "3", "spark.some.unknown": "x"}):
        assert spark.conf.get(key) == "3"
        raise ValueError
    assert spark.conf.get(key) == before and spark.conf.get("spark.some.unknown", None) is None


def test_galleries_are_replaced_kept_and_cleared(spark):
    product = spark.createDataFrame([(1, "p", "c", "9.00", "img")], "product_id long, name string, category string, base_price string, image_url string") \
        .withColumn("base_price", F.col("base_price").cast("decimal(18,2)"))
    req = spark.createDataFrame([(1, True, "new", None, None, None)],
                                "product_id long, has_list boolean, name string, category string, base_price decimal(18,2), image_url string")
    cols = "product_id long, sku string, color string, size string, price decimal(18,2), image_url string, is_active boolean"
    stored = spark.createDataFrame([(1, s, "o", "o", None, "v", False) for s in "ABCD"], cols)
    image = spark.createDataFrame([(s, f"{s}{i}") for s in "ABCD" for i in (2, 1)], "sku string, url string")
    new = spark.createDataFrame([(1, "A", "n", "n", None, None, None, ["z", "y"]), (1, "B", "n", "n", None, "own", False, None), (1, "C", "n", "n", None, None, True, []),
                                 (1, "E", "n", "n", None, None, None, None)], cols + ", gallery array<string>")
    got = {r.sku: (r.action, r.gallery, r.image_url, r.is_active, str(r.price)) for r in K.variant_merge(product, req, stored, new, image).collect()}
    assert got == {"A": ("UPDATE", ["z", "y"], "img", True, "9.00"), "B": ("UPDATE", ["B1", "B2"], "own", False, "9.00"), "C": ("UPDATE", [], "img", True, "9.00"),
                   "D": ("DELETE", ["D1", "D2"], "v", False, "None"), "E": ("INSERT", [], "img", True, "9.00")}
    patched = K.product_patch(product, req).first()
    assert (patched.name, patched.category, str(patched.base_price), patched.image_url) == ("new", "c", "9.00", "img")


def test_a_deleted_user_is_gone_until_registered_again(spark, monkeypatch):
    import datetime as dt
    t = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    e = lambda u, i, reg=False, dele=False, name=None, mail=None, phone=None, on=None: (u, t(i), i, reg, dele, name, mail, phone, None, on)
    ev = [e(1, 0, name="early"), e(1, 1, reg=True, name="a", mail="m", on=True), e(1, 2, phone="p"), e(1, 3, on=False),
          e(2, 1, reg=True, name="b", on=True), e(2, 2, dele=True), e(2, 3, name="ghost"),
          e(3, 1, reg=True, name="c", on=True), e(3, 2, dele=True), e(3, 4, reg=True, mail="n", on=True), e(4, 1, name="never")]
    df = spark.createDataFrame(ev, "user_id long, ts timestamp_ntz, event_id long, is_register boolean, is_delete boolean, full_name string, "
                                   "email string, phone string, address string, enabled boolean")
    for heavy in ({}, {1: 2, 3: 2}):
        monkeypatch.setattr(U, "heavy_keys", lambda df, key: heavy)
        got = {r.user_id: (r.full_name, r.email, r.phone, r.enabled, r.created_at[11:13], r.updated_at[11:13]) for r in U.user_dimension(df).collect()}
        assert got == {1: ("a", "m", "p", False, "01", "03"), 3: (None, "n", None, True, "04", "04")}
