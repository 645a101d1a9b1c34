"""Input bindings derived from the driver tables (FIXTURES.md section 3).

Each function maps (spark, sf_dir) to the event or entity DataFrame that the
jobs consume. They are plain projections / filters / unions over parquet
scans, so Catalyst prunes the columns and pushes the filters into the scans.
Money is converted to exact decimals *before* arithmetic (the test prices
carry two decimals), and every derived ordering key is kept as a column so
that folds can sort by the full total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MONEY
from ..sources.tables import table


def sku_of(key: Column) -> Column:
    return F.concat(F.lit("SKU-"), key.cast("string"))


def _money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def _div(col: str, n: int) -> Column:
    return F.expr(f"{col} div {n}")


def product(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter(F.col("p_partkey") % 4 == 0)
    pid = _div("p_partkey", 4)
    return p.select(
        pid.alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        _money(F.col("p_retailprice")).cast(MONEY).alias("base_price"),
        F.concat(F.lit("img/p"), pid.cast("string")).alias("image_url"))


def variant(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter(F.col("p_partkey") % 40 != 7)
    k = F.col("p_partkey")
    return p.select(
        _div("p_partkey", 4).alias("product_id"), sku_of(k).alias("sku"),
        F.col("p_brand").alias("color"), F.col("p_size").cast("string").alias("size"),
        F.when(k % 5 != 0, _money(F.col("p_retailprice")).cast(MONEY)).alias("price"),
        F.when(k % 3 != 0, F.concat(F.lit("img/v"), k.cast("string"))).alias("image_url"),
        F.when(k % 7 != 0, k % 11 != 0).alias("is_active"))


def image(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter(F.col("p_partkey") % 3 > 0)
    k = F.col("p_partkey")
    return (p.select(sku_of(k).alias("sku"), k,
                     F.explode(F.sequence(F.lit(0).cast("bigint"), (k % 3) - 1)).alias("i"))
            .select("sku", F.concat(F.lit("g/"), k.cast("string"), F.lit("/"), F.col("i").cast("string")).alias("url")))


def variant_req(spark: SparkSession, sf: str) -> DataFrame:
    """Requested variants; images, active flags and galleries come with some."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").filter((k % 4 != 1) & (_div("p_partkey", 4) % 10 != 0))
    url = lambda i: F.concat(F.lit("n/"), k.cast("string"), F.lit(f"/{i}"))
    return p.select(
        _div("p_partkey", 4).alias("product_id"), sku_of(k).alias("sku"),
        F.concat(F.lit("new-"), F.col("p_brand")).alias("color"), F.col("p_size").cast("string").alias("size"),
        F.when(k % 2 == 0, (_money(F.col("p_retailprice")) * F.lit(1.1).cast("decimal(2,1)")).cast(MONEY)).alias("price"),
        F.when(k % 6 == 0, F.concat(F.lit("new-img/"), k.cast("string"))).alias("image_url"),
        F.when(k % 7 < 2, k % 7 == 0).alias("is_active"),
        F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array(url(1), url(0))).alias("gallery"),
        (k % 300 - 20).cast("int").alias("initial_quantity"))


def product_req(spark: SparkSession, sf: str) -> DataFrame:
    """Product updates: fields that are null are not in the request; every tenth
    has no variant list."""
    pid = F.col("product_id")
    text = pid.cast("string")
    return product(spark, sf).select(
        "product_id", (pid % 10 != 0).alias("has_list"), F.when(pid % 4 == 0, F.concat(F.lit("renamed-"), text)).alias("name"),
        F.lit(None).cast("string").alias("category"),
        F.when(pid % 5 == 0, (F.col("base_price") * F.lit(2)).cast(MONEY)).alias("base_price"),
        F.when(pid % 6 == 0, F.concat(F.lit("img/new"), text)).alias("image_url"))


def product_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Product cache events; the latest ``seq`` per SKU wins, and ``ts`` says
    from when a row is in the cache. Some products appear late, so early
    orders and carts do not find them."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").filter(k % 100 != 99)
    late = k % 500 == 4      # not before January 2024
    day = lambda text, days: F.lit(text).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))
    first = (F.when(late, F.lit("2024-01-12")).when(k % 10 == 3, F.lit("1996-03-01")).otherwise(F.lit("1990-01-01"))).cast("timestamp_ntz")
    v1 = p.select(F.lit(1).cast("bigint").alias("seq"), first.alias("ts"), "*")
    v2 = p.filter((k % 2 == 0) & ~late).select(F.lit(2).cast("bigint").alias("seq"), day("1998-06-01", k % 30).alias("ts"), "*")
    v3 = p.filter(k % 7 < 5).select(F.lit(3).cast("bigint").alias("seq"), day("2024-01-08", k % 5 * 5).alias("ts"), "*")
    base = _money(F.col("p_retailprice"))
    raised = lambda by: (base * F.lit(by).cast("decimal(2,1)")).cast(MONEY)
    return v1.unionByName(v2).unionByName(v3).select(
        "seq", "ts", sku_of(k).alias("sku"), F.col("p_name").alias("name"),
        F.when(F.col("seq") == 1, base.cast(MONEY)).when(F.col("seq") == 2, raised(1.1)).otherwise(raised(1.2)).alias("price"),
        F.col("p_brand").alias("color"), F.col("p_size").cast("string").alias("size"),
        F.when(k % 3 != 0, F.concat(F.lit("img/v"), k.cast("string"))).alias("image_url"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines; total order (ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, qty)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("l_orderkey").cast("string").alias("order_number"), sku_of(F.col("l_partkey")).alias("sku"),
        F.col("l_quantity").cast("int").alias("qty"), F.col("o_orderdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def change_sign():
    """Every line moves stock: returns add, the rest takes away once or twice."""
    return F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -2).otherwise(-1)


def flow_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Stock changes of the order flow: what a SKU starts with, and for every
    line a receipt or a loss on its ship date, so that stock is scarce at times."""
    p = table(spark, sf, "part")
    created = p.select(
        sku_of(F.col("p_partkey")).alias("sku"), (F.col("p_size") * 6).cast("bigint").alias("chg"),
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit(0).cast("bigint").alias("l_orderkey"),
        F.lit(0).cast("int").alias("l_linenumber"), F.lit(0).cast("bigint").alias("l_suppkey"))
    li = table(spark, sf, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(1)
    adjust = li.select(sku_of(F.col("l_partkey")).alias("sku"), (sign * F.col("l_quantity")).cast("bigint").alias("chg"),
                       F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_suppkey")
    return created.unionByName(adjust)


def opening(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter(F.col("p_partkey") % 50 != 7)
    return p.select(sku_of(F.col("p_partkey")).alias("sku"), (F.col("p_size") * 20).cast("bigint").alias("stock"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Stock check results, arriving up to eleven minutes after placement;
    per order in the order of (ts, l_linenumber, l_partkey, l_suppkey, qty)."""
    q, delay = F.col("qty"), (F.col("l_linenumber") * 211 + F.col("l_partkey")) % 640
    return lines(spark, sf).select(
        "order_number", "sku", (q <= 45).alias("success"),
        F.when(q > 45, F.concat(F.lit("Not enough stock for "), F.col("sku"))).alias("reason"),
        (F.col("ts") + F.make_dt_interval(secs=delay)).alias("ts"), "l_linenumber", "l_partkey", "l_suppkey", "qty")


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    """Saga record: when it is created, and the items expected (one extra for
    every tenth order)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    per_order = (table(spark, sf, "lineitem").groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("n")))
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").cast("string").alias("order_number"), F.col("o_orderdate").alias("created"),
        (F.coalesce(F.col("n"), F.lit(0)) + (F.col("o_orderkey") % 10 == 0).cast("bigint")).alias("total_items"))


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    """Order / payment events; per-order order (ts, kind)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    num = k.cast("string")
    validated = o.filter(k % 3 != 0).select(num.alias("order_number"), F.lit("VALIDATED").alias("kind"),
                                            (d + F.expr("INTERVAL 24 HOURS")).alias("ts"))
    failed = o.filter(k % 5 == 0).select(num.alias("order_number"), F.lit("FAILED").alias("kind"),
                                         (d + F.expr("INTERVAL 36 HOURS")).alias("ts"))
    pay = o.filter(F.col("o_orderstatus") != "O").select(
        num.alias("order_number"),
        F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("PAY_FAILED").alias("kind"),
        F.when(k % 7 == 0, d + F.expr("INTERVAL 12 HOURS")).otherwise(d + F.expr("INTERVAL 48 HOURS")).alias("ts"))
    ghost = o.filter(k % 100 == 0).select(F.concat(F.lit("X"), num).alias("order_number"),
                                          F.lit("PAID").alias("kind"), d.alias("ts"))
    return validated.unionByName(failed).unionByName(pay).unionByName(ghost)


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """Order placed events: every order is PENDING at its order date."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.select(F.col("o_orderkey").cast("string").alias("order_number"),
                    F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))


def placed_with_items(spark: SparkSession, sf: str) -> DataFrame:
    """Order placed events as they are sent: with the order's own items."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("order_number")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", sku_of(F.col("l_partkey")).alias("sku"),
                                             F.col("l_quantity").cast("int").alias("qty")))).alias("items"))
    return placed(spark, sf).join(li, "order_number", "left").withColumn(
        "items", F.coalesce("items", F.array().cast(li.schema["items"].dataType)))


def cart_ev(spark: SparkSession, sf: str) -> DataFrame:
    """Cart events; per-user order (ts, event_id)."""
    e = table(spark, sf, "events")
    t, i = F.col("event_type"), F.col("event_id")
    e = e.filter(t.isin("click", "error", "purchase"))
    return e.select(
        "user_id", "ts", "event_id",
        F.when(t == "click", "add").when(t == "error", "remove").otherwise("checkout").alias("kind"),
        sku_of(i % 5).alias("sku"), (1 + i % 3).cast("int").alias("qty"))


def user_patch(spark: SparkSession, sf: str) -> DataFrame:
    """User register / patch / disable / delete events; per-user order (ts, event_id)."""
    e = table(spark, sf, "events")
    t, i = F.col("event_type"), F.col("event_id")
    delete = (t == "purchase") & (i % 20 == 0)   # other purchases patch the phone
    return e.select(
        "user_id", "ts", "event_id", (t == "signup").alias("is_register"), delete.alias("is_delete"),
        F.when((t == "signup") | ((t == "view") & (i % 3 == 0)), F.concat(F.lit("user "), i.cast("string"))).alias("full_name"),
        F.when((t == "signup") | ((t == "click") & (i % 4 == 0)), F.concat(F.lit("u"), i.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when((t == "click") | ((t == "purchase") & ~delete), F.concat(F.lit("+84-"), i.cast("string"))).alias("phone"),
        F.when(t == "view", F.concat(F.lit("addr-"), i.cast("string"))).alias("address"),
        F.when(t == "signup", F.lit(True)).when(t == "error", F.lit(False)).alias("enabled"))


def adjust_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw adjustment request bodies."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    # (value - 100) rounded half-to-even to an int, as a double->int cast does in SQL engines
    q = F.bround(F.col("value") - 100, 0).cast("int").cast("string")
    m = i % 10
    body = (F.when(m == 0, F.lit('{"adjustmentQuantity":5}'))
            .when(m == 1, F.concat(F.lit('{"skuCode":"SKU-'), (i % 2000).cast("string"), F.lit('"}')))
            .when(m == 2, F.lit('{"skuCode":"SKU-1","adjustmentQuantity":"abc"}'))
            .when(m == 3, F.lit('{"skuCode":"SKU-1","adjustmentQuantity":0}'))
            .when(m == 4, F.lit('{broken'))
            .otherwise(F.concat(F.lit('{"skuCode":"SKU-'), (i % 2000).cast("string"),
                                F.lit('","adjustmentQuantity":'), q, F.lit("}"))))
    return e.select("event_id", "ts", body.alias("body"))


def payload_raw(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    m = F.col("event_id") % 4
    raw = (F.when(m == 0, F.concat(F.lit("#@1"), F.col("props")))
           .when(m == 1, F.col("props"))
           .when(m == 2, F.lit(None).cast("string"))
           .otherwise(F.lit("no brace")))
    return e.select("event_id", raw.alias("raw"))
