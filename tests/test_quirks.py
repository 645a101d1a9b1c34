"""Hand-made cases for the semantics of SURVEY section 7.4 (not reached by the driver rows)."""
import datetime as dt

from pyspark.sql import functions as F

from emporia.functions.scalars import INT_MAX, tolerant_int
from emporia.operators import cart as C
from emporia.operators import orders as O
from emporia.operators import reservation as R
from emporia.operators import status as S
from emporia.operators import stock as ST
from emporia.sources import events as EV

T0 = dt.datetime(2024, 1, 1)


def _changes(spark, rows):
    return spark.createDataFrame(
        [(sku, chg, T0 + dt.timedelta(hours=i), 0, 0, 0, "adjustment") for i, (sku, chg) in enumerate(rows)],
        "sku string, chg long, ts timestamp_ntz, l_orderkey long, l_linenumber int, l_suppkey long, source string")


def test_stock_upper_clamp(spark):
    df = _changes(spark, [("A", INT_MAX - 5), ("A", 100), ("A", -10), ("B", -5), ("B", 3)])
    got = {r.sku: r.stock for r in ST.stock_level(df).collect()}
    assert got == {"A": INT_MAX - 10, "B": 3}


def test_plain_sum_is_wrong_when_floor_hits(spark):
    df = _changes(spark, [("A", 5), ("A", -10), ("A", 4)])
    assert ST.stock_level(df).first().stock == 4  # not -1


def _lines(spark, rows):
    return spark.createDataFrame(
        [(f"o{i}", sku, q, T0 + dt.timedelta(hours=i), i, 1, 1, 1) for i, (sku, q) in enumerate(rows)],
        "order_number string, sku string, qty int, ts timestamp_ntz, l_orderkey long, l_linenumber int, "
        "l_partkey long, l_suppkey long")


def test_reservation_negative_quantity_raises_stock(spark):
    opening = spark.createDataFrame([("A", 3)], "sku string, stock long")
    res = R.reserve(_lines(spark, [("A", 5), ("A", -4), ("A", 5), ("Z", 1)]), opening=opening).orderBy("ts").collect()
    assert [r.success for r in res] == [False, True, True, False]
    assert res[0].reason == "Not enough stock for A (need 5, have 3)"
    assert [r.stock_after for r in res[:3]] == [3, 7, 2]
    assert res[3].reason == "Not enough stock for Z (need 1, have 0)"  # missing stock counts 0


def test_reservation_state_carries_across_arrow_batches(spark):
    opening = spark.createDataFrame([("A", 150)], "sku string, stock long")
    res = R.reserve(_lines(spark, [("A", 1)] * 200), opening=opening, partitions=2)
    assert res.filter("success").count() == 150
    assert res.agg(F.min("stock_after")).first()[0] == 0


def test_unknown_sku_rejects_whole_order_and_empty_order_totals_zero(spark):
    feed = spark.createDataFrame([(1, T0, "A", "a", "1.10", "c", "s")],
                                 "seq long, ts timestamp_ntz, sku string, name string, price string, color string, size string") \
        .withColumn("price", F.col("price").cast("decimal(18,2)"))
    lines = _lines(spark, [("A", 2), ("B", 1)]).withColumn("order_number", F.lit("o1"))
    lines = lines.unionByName(_lines(spark, [("A", 3)]).withColumn("order_number", F.lit("o2")))
    placed = spark.createDataFrame([("o1",), ("o2",), ("o3",)], "order_number string")
    tot = {r.order_number: (r.line_count, str(r.total_price))
           for r in O.order_totals(placed, O.price_lines(lines, feed)).collect()}
    assert tot == {"o2": (1, "3.30"), "o3": (0, "0.00")}


def test_repeated_result_is_counted_once(spark):
    res = spark.createDataFrame([("o1", "A", True, None, T0 + dt.timedelta(minutes=m), 1, 1, 1, 1) for m in (0, 1)]
                                + [("o1", "B", True, None, T0 + dt.timedelta(minutes=2), 2, 2, 1, 1)],
                                "order_number string, sku string, success boolean, reason string, ts timestamp_ntz, "
                                "l_linenumber int, l_partkey long, l_suppkey long, qty int")
    items = spark.createDataFrame([("o1", T0, 2)], "order_number string, created timestamp_ntz, total_items long")
    r = O.order_outcome(res, items).first()
    assert (r.outcome, r.received) == ("VALIDATED", 2)


def test_completed_before_validated_ignores_validation(spark):
    log = spark.createDataFrame([("o1", "PAID", T0 + dt.timedelta(hours=1)),
                                 ("o1", "VALIDATED", T0 + dt.timedelta(hours=2)),
                                 ("o2", "VALIDATED", T0 + dt.timedelta(hours=1)),
                                 ("o2", "FAILED", T0 + dt.timedelta(hours=2))],
                                "order_number string, kind string, ts timestamp_ntz")
    placed = spark.createDataFrame([("o1", T0), ("o2", T0)], "order_number string, ts timestamp_ntz")
    summ = S.status_summary(log, placed)
    assert {r.order_number: r.status for r in S.final_status(summ).collect()} == {"o1": "COMPLETED",
                                                                                  "o2": "VALIDATED"}
    tr = sorted((r.order_number, r.status) for r in S.transitions(summ).collect())
    assert tr == [("o1", "COMPLETED"), ("o1", "PENDING"), ("o2", "PENDING"), ("o2", "VALIDATED")]


def test_dedup_first_wins(spark):
    ev = spark.createDataFrame([("o1", 1, T0, 1), ("o1", 9, T0, 0), ("o1", 5, T0 + dt.timedelta(1), 0)],
                               "order_number string, user_id long, ts timestamp_ntz, attempt int")
    assert O.dedup_first(ev, "order_number", ["ts", "attempt"]).first().user_id == 9


def test_tolerant_int_and_null_quantity(spark):
    df = spark.createDataFrame([("5",), ("-7",), ("1.5",), ("abc",), (None,), (" 12 ",)], "x string")
    assert [r.v for r in df.select(tolerant_int(F.col("x")).alias("v")).collect()] == [5, -7, None, None, None, 12]


def test_blank_sku_is_reported(spark):
    lines = spark.createDataFrame([("o", " ", 1), ("o", "A", 0), ("o", "A", 2)],
                                  "order_number string, sku string, qty int")
    r = O.line_quality(lines).first()
    assert (r.n_lines, r.n_blank_sku, r.n_bad_qty, r.n_valid) == (3, 1, 1, 1)


def test_unknown_topic_is_dropped_and_bad_payload_isolated(spark):
    feed = spark.createDataFrame([("order-placed-topic", "k", '{"orderNumber":"1","userId":7}'),
                                  ("some-other-topic", "k", '{"orderNumber":"2"}'),
                                  ("order-failed-topic", "k", "#junk{not json")],
                                 "topic string, key string, value string")
    assert [(r.handler, r.order_number) for r in EV.event_dispatch(feed).collect()] == [("placement", "1")]
    assert [(r.topic, r.value) for r in EV.event_quarantine(feed).collect()] == [("order-failed-topic", "#junk{not json")]


def test_placed_event_carries_its_items(spark):
    feed = spark.createDataFrame([("order-placed-topic", "k", '{"orderNumber":"1","userId":7,"orderLineItemsDtoList":'
                                   '[{"skuCode":"A","quantity":2},{"skuCode":"B","quantity":3}]}')], "topic string, key string, value string")
    assert [(r.n_items, r.total_qty) for r in EV.event_dispatch(feed).collect()] == [(2, 5)]


def test_lenient_decode(spark):
    raw = spark.createDataFrame([(1, 'xx{"k": 3}'), (2, None), (3, "no brace")], "event_id long, raw string")
    got = {r.event_id: (r.cleaned, r.k) for r in EV.decode_payload(raw).collect()}
    assert got == {1: ('{"k": 3}', 3), 2: ("", None), 3: ("no brace", None)}


def test_feed_size_and_repeated_warmup_adds(spark):
    from emporia.operators import catalog as K
    product = spark.createDataFrame([(1, "p", "1.00", "img/p1"), (2, "q", "2.00", "img/p2")],
                                    "product_id long, name string, base_price string, image_url string") \
        .withColumn("base_price", F.col("base_price").cast("decimal(18,2)"))
    variant = spark.createDataFrame([(1, "S1", "c", "m", None, None, None), (1, "S2", "c", "l", None, "v2", True)],
                                    "product_id long, sku string, color string, size string, price decimal(18,2), "
                                    "image_url string, is_active boolean")
    feed = K.catalog_feed(product, variant)
    assert feed.count() == 4  # E10: 2 variants sent; product 2 has none and sends nothing (B7)
    cache = {r.sku: (str(r.price), r.image_url) for r in feed.filter("feed = 'cache'").collect()}
    assert cache == {"S1": ("1.00", "img/p1"), "S2": ("1.00", "v2")}
    created = feed.filter("feed = 'created'").select("sku", F.col("initial_quantity").alias("q"))
    twice = created.unionByName(created).select(
        "sku", F.col("q").cast("bigint").alias("chg"), F.lit(T0).cast("timestamp_ntz").alias("ts"),
        F.monotonically_increasing_id().alias("l_orderkey"), F.lit(0).alias("l_linenumber"),
        F.lit(0).cast("bigint").alias("l_suppkey"), F.lit("created").alias("source"))
    assert {r.sku: r.stock for r in ST.stock_level(twice).collect()} == {"S1": 2000, "S2": 2000}


def test_null_variant_list_sends_no_feed(spark):
    from emporia.operators import catalog as K
    merged = spark.createDataFrame([(1, "S1", "KEEP"), (2, "S2", "UPDATE"), (2, "S3", "DELETE"), (2, "S4", "INSERT")],
                                   "product_id long, sku string, action string") \
        .select("*", F.lit("c").alias("color"), F.lit("m").alias("size"),
                F.lit("1.00").cast("decimal(18,2)").alias("price"), F.lit(None).cast("string").alias("image_url"))
    product = spark.createDataFrame([(1, "p", "img/p1"), (2, "q", "img/p2")],
                                    "product_id long, name string, image_url string")
    got = sorted((r.feed, r.sku, r.initial_quantity) for r in K.merge_feed(merged, product).collect())
    assert got == [("cache", "S2", None), ("cache", "S4", None), ("created", "S2", 0), ("created", "S4", 0)]


def test_keyed_sink_puts_a_key_in_one_bucket(spark):
    from emporia.session import scratch_path
    from emporia.sources import sinks as SK
    path = scratch_path(spark, "t-keyed")
    rows = [("HOT", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)]
    SK.write_keyed(spark.createDataFrame(rows, "sku string, n long"), "sku", path, buckets=8)
    back = SK.read_keyed(spark, path)
    per_key = back.groupBy("sku").agg(F.countDistinct("bucket").alias("b"), F.count(F.lit(1)).alias("c"))
    assert per_key.filter("b != 1").count() == 0
    assert back.count() == 350 and per_key.filter("sku = 'HOT'").first().c == 300


def test_payment_sees_status_before_it_at_equal_time(spark):
    log_rows = [("o1", "PAID", T0 + dt.timedelta(hours=5)), ("o1", "VALIDATED", T0 + dt.timedelta(hours=5)),
                ("o2", "PAID", T0), ("X9", "PAID", T0 + dt.timedelta(hours=1))]
    log = spark.createDataFrame(log_rows, "order_number string, kind string, ts timestamp_ntz")
    placed = spark.createDataFrame([("o1", T0), ("o2", T0)], "order_number string, ts timestamp_ntz")
    trans = S.transitions(S.status_summary(log, placed))
    pays = log.filter("kind = 'PAID'").select("order_number", "ts", F.explode(F.array(F.lit("p1"), F.lit("p2"))).alias("payment_id"))
    got = sorted((r.order_number, r.payment_id, r.status_at_arrival)
                 for r in S.payment_gate(pays, trans).collect())
    # o1: VALIDATED and PAID at the same instant -> the payment sees PENDING (placed);
    # o2: paid at placement time -> nothing strictly before it -> dropped; X9 unknown -> dropped
    # two payments at one instant are two payments
    assert got == [("o1", "p1", "PENDING"), ("o1", "p2", "PENDING")]


def test_failed_order_keeps_taken_stock_and_same_sku_twice(spark):
    """Quirks 2 and 15: a line refused later does not give back what earlier
    lines took (only a payment failure restocks); the same SKU on two lines
    of one order is two independent requests."""
    opening = spark.createDataFrame([("A", 5), ("B", 0)], "sku string, stock long")
    rows = [("o1", "A", 3, T0, 1, 1, 1, 1), ("o1", "A", 1, T0, 1, 2, 1, 1), ("o1", "B", 2, T0, 1, 3, 2, 1)]
    lines = spark.createDataFrame(rows, "order_number string, sku string, qty int, ts timestamp_ntz, l_orderkey long, "
                                        "l_linenumber int, l_partkey long, l_suppkey long")
    res = R.reserve(lines, opening=opening).orderBy("l_linenumber").collect()
    assert [(r.sku, r.success, r.stock_after) for r in res] == [("A", True, 2), ("A", True, 1), ("B", False, 0)]
    log = spark.createDataFrame([("o1", "FAILED", T0 + dt.timedelta(hours=1))],
                                "order_number string, kind string, ts timestamp_ntz")
    placed = spark.createDataFrame([("o1", T0)], "order_number string, ts timestamp_ntz")
    trans = S.transitions(S.status_summary(log, placed))
    assert S.restock_compensation(trans, lines).count() == 0
    log2 = spark.createDataFrame([("o1", "PAY_FAILED", T0 + dt.timedelta(hours=1))],
                                 "order_number string, kind string, ts timestamp_ntz")
    comp = S.restock_compensation(S.transitions(S.status_summary(log2, placed)), lines).collect()
    assert sorted((r.sku, r.adjustment_quantity) for r in comp) == [("A", 1), ("A", 3), ("B", 2)]
    assert comp[0].reason == "COMPENSATION: Payment Failed for Order o1"


def test_cart_price_is_dropped_and_rejected_order_still_notified(spark):
    """Quirks 7, 1 and 8: the order request carries no cart price; an order
    rejected for an unknown SKU is not saved but its PENDING notice is sent;
    an order without lines stays PENDING."""
    ck = spark.createDataFrame([(1, 10, [("A", 2, "9.99")])],
                               "user_id long, checkout_id long, items array<struct<sku:string,qty:int,price:string>>")
    req = O.checkout_to_order(ck).first()
    assert [tuple(i) for i in req.items] == [("A", 2)] and len(req.order_number) == 64
    placed = spark.createDataFrame([("o1", T0), ("o2", T0)], "order_number string, ts timestamp_ntz")
    log = spark.createDataFrame([], "order_number string, kind string, ts timestamp_ntz")
    failures = spark.createDataFrame([], "order_number string, reason string, ts timestamp_ntz")
    feed = {(r.order_number, r.status) for r in S.notification_feed(placed, log, failures).collect()}
    assert feed == {("o1", "PENDING"), ("o2", "PENDING")}
    items = spark.createDataFrame([("o2", T0, 0)], "order_number string, created timestamp_ntz, total_items long")
    empty = spark.createDataFrame([], "order_number string, sku string, success boolean, reason string, ts timestamp_ntz, "
                                      "l_linenumber int, l_partkey long, l_suppkey long, qty int")
    assert O.order_outcome(empty, items).first().outcome == "PENDING"


def test_create_feed_has_no_image_fallback(spark):
    """Quirk 4: create sends the variant image as given (no product fallback);
    the requested initial quantity, floored at 0 by the ledger, is sent."""
    from emporia.operators import catalog as K
    product = spark.createDataFrame([(1, "p", "2.00", "img/p1")],
                                    "product_id long, name string, base_price string, image_url string") \
        .withColumn("base_price", F.col("base_price").cast("decimal(18,2)"))
    req = spark.createDataFrame([(1, "S1", "c", "m", None, None, 7), (1, "S2", "c", "l", "3.50", "v2", -4)],
                                "product_id long, sku string, color string, size string, price string, "
                                "image_url string, initial_quantity int") \
        .withColumn("price", F.col("price").cast("decimal(18,2)"))
    feed = K.create_feed(product, req)
    cache = {r.sku: (str(r.price), r.image_url) for r in feed.filter("feed = 'cache'").collect()}
    assert cache == {"S1": ("2.00", None), "S2": ("3.50", "v2")}
    created = feed.filter("feed = 'created'").select(
        "sku", F.col("initial_quantity").alias("initial_quantity"), F.lit(T0).cast("timestamp_ntz").alias("ts"),
        F.lit(0).cast("bigint").alias("l_orderkey"), F.lit(0).alias("l_linenumber"),
        F.lit(0).cast("bigint").alias("l_suppkey"))
    no_adj = created.select("sku", F.lit(0).cast("bigint").alias("adjustment_quantity"), "ts", "l_orderkey",
                            "l_linenumber", "l_suppkey").limit(0)
    stock = {r.sku: r.stock for r in ST.stock_level(ST.stock_changes(created, no_adj)).collect()}
    assert stock == {"S1": 7, "S2": 0}
