"""Order jobs: pricing, totals, gather outcome, dedup, scatter.

Shuffles are on the business keys (SKU for the price lookup, order number for
everything per order). Per-order results use aggregates, not windows, so
Spark's partial aggregation pre-combines a hot order map-side; per-row ranks
use the running values of ``plans.running``, which cut hot keys into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (MONEY, STATUS_FAILED, STATUS_PENDING, STATUS_VALIDATED, fmt_ts,
                                 line_amount, replay_safe_id)
from ..plans.running import running
from ..plans.skew import asof_join, heavy_keys, split_join, validity


def product_latest(feed: DataFrame) -> DataFrame:
    """Latest product row per SKU (``seq`` decides).

    One hash aggregate with map-side partial ``max_by``; output is one row
    per SKU, i.e. catalogue-sized.
    """
    latest = feed.groupBy("sku").agg(F.max_by(F.struct(*[c for c in feed.columns if c != "sku"]),
                                              F.col("seq")).alias("r"))
    return latest.select("sku", "r.*")


def first_seen(feed: DataFrame) -> DataFrame:
    """(sku, known_from): since when a product is in the cache; it never leaves it."""
    return feed.groupBy("sku").agg(F.min("ts").alias("known_from"))


def unsaved_orders(lines: DataFrame, feed: DataFrame, heavy: dict[str, int] | None = None) -> DataFrame:
    """Numbers of the orders with a line whose SKU was not in the cache
    when the order was placed. They are never saved, so whatever refers to
    them later finds no order."""
    j = split_join(lines.select("order_number", "sku", "ts", "l_linenumber"), first_seen(feed), "sku", heavy or {})
    return j.where(F.col("known_from").isNull() | (F.col("known_from") > F.col("ts"))).select("order_number").distinct()


def unsaved_from(priced: DataFrame, lines: DataFrame, feed: DataFrame) -> DataFrame:
    """:func:`unsaved_orders` of lines that are priced already: from its first
    appearance on some version of a product holds, so a line is without one
    before it only. Lines without a time hold no version and are looked up."""
    timed = priced.where(~F.col("found") & F.col("ts").isNotNull()).select("order_number")
    return timed.unionByName(unsaved_orders(lines.where("ts IS NULL"), feed)).distinct()


def saved_orders(placed: DataFrame, lines: DataFrame, feed: DataFrame, heavy: dict[str, int] | None = None) -> DataFrame:
    """The placed orders that are in the order table."""
    return placed.join(unsaved_orders(lines, feed, heavy), "order_number", "left_anti")


def price_lines(lines: DataFrame, feed: DataFrame, heavy: dict[str, int] | None = None) -> DataFrame:
    """Lines joined with the product row that the cache held when the order was
    placed (left; ``found`` says whether there was one).

    No broadcast hint: the catalogue grows with the data, so adaptive execution
    decides by measured size; the lines of a hot SKU (``heavy``) are dealt over
    salts and its few product rows repeated.
    """
    held = validity(feed, "sku", "ts", ["seq"]).select(
        "sku", F.col("price"), F.col("name").alias("product_name"), "color", "size", F.lit(True).alias("found"), "_since", "_until")
    spread = [c for c in ("l_orderkey", "l_linenumber") if c in lines.columns]
    return (asof_join(lines, held, "sku", "ts", heavy or {}, spread=spread)
            .withColumn("found", F.coalesce(F.col("found"), F.lit(False))))


def order_line_summary(priced: DataFrame) -> DataFrame:
    """Per order, in one partial aggregate: line count, total of the priced
    lines, and how many lines have no product row (the D2 reject signal)."""
    missing = ~F.col("found")
    return priced.groupBy("order_number").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.when(missing, 1).otherwise(0)).alias("missing_lines"),
        F.min(F.when(missing, F.col("sku"))).alias("first_missing_sku"),
        F.sum(line_amount(F.col("price"), F.col("qty"))).alias("total"))


def rejected_orders(priced: DataFrame) -> DataFrame:
    """D2 rejects: orders with at least one SKU not in the product cache."""
    return (order_line_summary(priced).filter(F.col("missing_lines") > 0)
            .select("order_number", "missing_lines", "first_missing_sku"))


def accepted_lines(priced: DataFrame, unsaved: DataFrame) -> DataFrame:
    """Lines of orders whose every SKU is known (all-or-nothing per order).

    An anti join against the unsaved orders, which come from the lines and the
    products' first appearance, so the priced lines are computed once.
    """
    return (priced.join(unsaved, "order_number", "left_anti")
            .withColumn("line_amount", line_amount(F.col("price"), F.col("qty"))))


def order_totals(orders_placed: DataFrame, priced: DataFrame) -> DataFrame:
    """E1 + C1: order total = sum(price x qty), exact decimal; 0 for no lines;
    orders with an unknown SKU are not saved (D2).

    One scan of the lines, one aggregate per order (map-side partial), one
    join with the placed orders: a rejected order is recognised from the
    same aggregate that totals it.
    """
    summary = order_line_summary(priced)
    j = orders_placed.select("order_number").join(summary, "order_number", "left")
    return (j.filter(F.coalesce(F.col("missing_lines"), F.lit(0)) == 0)
            .select("order_number",
                    F.coalesce(F.col("line_count"), F.lit(0)).cast("bigint").alias("line_count"),
                    F.coalesce(F.col("total"), F.lit(0)).cast(MONEY).alias("total_price")))


def enriched_lines(priced: DataFrame, unsaved: DataFrame) -> DataFrame:
    """D2 output rows: the saved line items with their cached product data, and
    with the line's keys that ``priced`` has."""
    keys = [c for c in ("l_linenumber", "l_partkey", "l_suppkey") if c in priced.columns]
    return accepted_lines(priced, unsaved).select(
        "order_number", "sku", "qty", *keys,
        F.col("price").cast(MONEY).alias("price"), "product_name", "color", "size",
        F.col("line_amount").cast(MONEY).alias("line_amount"))


ARRIVAL = ["ts", "l_linenumber", "l_partkey", "l_suppkey", "qty"]
SAGA_TTL_SECONDS = 600


def _ttl_end(ttl: int) -> F.Column:
    return F.col("created") + F.make_dt_interval(secs=F.lit(ttl))


def distinct_results(results: DataFrame) -> DataFrame:
    """Every result once, as it first arrived: a repeated delivery is the same
    line with the same answer. Only that identity is shuffled, pre-aggregated."""
    same = ["order_number", "sku", "success", *ARRIVAL[1:]]
    return results.groupBy(*same).agg(F.min(F.struct("ts", "reason")).alias("r")).select(*same, "r.*")


def arrivals(results: DataFrame, saga: DataFrame, ttl: int = SAGA_TTL_SECONDS, heavy: dict | None = None) -> DataFrame:
    """Distinct results with ``n`` (how many of the order have arrived) and what
    the order's saga record says then: ``total_items`` and ``alive`` (it exists
    from placement for ``ttl`` seconds)."""
    heavy = heavy_keys(results, "order_number") if heavy is None else heavy
    ranked = running(distinct_results(results), "order_number", ARRIVAL, sums={"n": F.lit(1).cast("bigint")}, heavy=heavy)
    record = saga.select("order_number", "total_items", "created")
    return (split_join(ranked, record, "order_number", heavy, spread=["n"])
            .withColumn("alive", F.coalesce(F.col("ts") <= _ttl_end(ttl), F.lit(False))))


def order_outcome(results: DataFrame, saga: DataFrame, ttl: int = SAGA_TTL_SECONDS) -> DataFrame:
    """E3 (+E6, D6): n line results -> one outcome per order.

    VALIDATED when the count *reaches* the expected items while the saga record
    is alive and no result has failed till then; else FAILED with the reason of
    the first failing result, if one fails; else PENDING. ``received`` is the
    record's counter: results before it expired or was cleared on completion.
    """
    a = arrivals(results, saga, ttl)
    failed = ~F.col("success")
    agg = a.groupBy("order_number").agg(
        F.sum(F.col("alive").cast("bigint")).alias("within"), F.min(F.when(failed, F.col("n"))).alias("failed_at"),
        F.min_by("reason", F.when(failed, F.col("n"))).alias("first_reason"))
    j = saga.join(agg, "order_number", "left")
    total, within = F.col("total_items"), F.coalesce("within", F.lit(0))
    validated = (total >= 1) & (within >= total) & (F.col("failed_at").isNull() | (F.col("failed_at") > total))
    lost = ~validated & F.col("failed_at").isNotNull()
    outcome = F.when(validated, F.lit(STATUS_VALIDATED)).when(lost, F.lit(STATUS_FAILED)).otherwise(F.lit(STATUS_PENDING))
    return j.select("order_number", outcome.alias("outcome"), F.when(lost, F.col("first_reason")).alias("reason"),
                    F.when(validated, total).otherwise(within).cast("bigint").alias("received"), total.cast("bigint").alias("total_items"))


def failure_events(results: DataFrame, saga: DataFrame, ttl: int = SAGA_TTL_SECONDS) -> DataFrame:
    """Failed-order events of the gather: the first failing result of an order,
    and the first one after its saga record has expired, as the record's failed
    mark is gone then."""
    bad = arrivals(results, saga, ttl).where(~F.col("success"))
    return (bad.groupBy("order_number", "alive").agg(F.min_by(F.struct("reason", "ts"), "n").alias("e"))
            .select("order_number", "e.reason", "e.ts"))


def gather_progress(results: DataFrame, saga: DataFrame, ttl: int = SAGA_TTL_SECONDS) -> DataFrame:
    """progress n / total per result, n = arrival rank within the order; no
    total once the saga record has expired.

    The rank is a running count, so an order with a huge number of results is
    cut into pieces that lie in many tasks.
    """
    a = arrivals(results, saga, ttl)
    return a.select("order_number", "sku", *ARRIVAL[1:], F.col("n").alias("received_n"),
                    F.when(F.col("alive"), F.col("total_items")).cast("bigint").alias("total_items"))


def first_failure(results: DataFrame) -> DataFrame:
    """the first failing result per order wins; later ones are ignored."""
    f = results.filter(~F.col("success"))
    rest = ARRIVAL[1:]
    agg = f.groupBy("order_number").agg(F.min_by(F.struct("sku", "reason", *rest), F.struct(*ARRIVAL)).alias("r"),
                                        F.count(F.lit(1)).alias("failures"))
    return agg.select("order_number", "r.sku", "r.reason", *[F.col(f"r.{c}") for c in rest],
                      F.col("failures").cast("bigint").alias("failures"))


def dedup_first(events: DataFrame, key: str, order_cols) -> DataFrame:
    """First event per key wins (a replay hits the unique key and is skipped).

    ``min_by`` over the full order tuple: one aggregate with partial
    aggregation, no window, so a hot key is pre-combined map-side.
    """
    rest = [c for c in events.columns if c != key]
    seq = F.struct(*[F.col(c) for c in order_cols])
    return events.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def checkout_to_order(checkouts: DataFrame) -> DataFrame:
    """B1: cart checkout -> order request; the cart price is dropped on purpose.

    The order number is a hash of (user, checkout id) instead of a random
    UUID, so a replay produces the same number (C13).
    """
    return checkouts.select(
        replay_safe_id(F.col("user_id"), F.col("checkout_id")).alias("order_number"),
        "user_id", "checkout_id",
        F.transform("items", lambda x: F.struct(x["sku"].alias("sku"), x["qty"].alias("qty"))).alias("items"))


def check_requests(order_requests: DataFrame) -> DataFrame:
    """Scatter an order into one stock check request per line, keyed by SKU.

    ``explode`` is narrow. The re-keying to the stock owner is not done here:
    the consumer (the reservation fold) partitions by SKU itself, so an extra
    shuffle would only send a hot SKU to one task twice.
    """
    e = order_requests.select("order_number", F.posexplode("items").alias("line_no", "item"))
    return e.select("order_number", F.col("line_no").cast("int").alias("line_no"),
                    F.col("item.sku").alias("sku"), F.col("item.qty").cast("int").alias("qty"))


def line_quality(lines: DataFrame) -> DataFrame:
    """Declared line rule (SKU not blank, quantity >= 1) as a quality report."""
    blank = (F.col("sku").isNull()) | (F.length(F.trim(F.col("sku"))) == 0)
    bad_qty = F.col("qty").isNull() | (F.col("qty") < 1)
    return lines.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.sum(F.when(blank, 1).otherwise(0)).cast("bigint").alias("n_blank_sku"),
        F.sum(F.when(bad_qty, 1).otherwise(0)).cast("bigint").alias("n_bad_qty"),
        F.sum(F.when(~blank & ~bad_qty, 1).otherwise(0)).cast("bigint").alias("n_valid"))


def order_document(totals: DataFrame, placed: DataFrame, final_status: DataFrame, enriched: DataFrame) -> DataFrame:
    """B2 + D4: the order document (order fields ⟕ its line items), in
    relational form: one row per line, one row with null line fields for an
    order without lines; the date rendered ``yyyy-MM-dd HH:mm:ss``."""
    head = (totals.join(placed.select("order_number", "ts"), "order_number")
            .join(final_status.select("order_number", "status"), "order_number", "left"))
    li = enriched.select("order_number", "sku", "qty", "price", "product_name", "color", "size")
    return (head.join(li, "order_number", "left")
            .select("order_number", "status", "total_price", fmt_ts(F.col("ts")).alias("order_date"),
                    "sku", "qty", "price", "product_name", "color", "size"))
