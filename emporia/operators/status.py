"""Order status machine and what is derived from it.

Machine: PENDING -> VALIDATED; PENDING -> FAILED; PENDING or VALIDATED ->
COMPLETED (payment ok) or PAYMENT_FAILED; every other event is ignored.

Closed form (no fold needed): before the first terminal event the state is
PENDING or VALIDATED, so the terminal event is the earliest of (a) the first
payment event and (b) the first failure, if no validation precedes it. A
validation counts if it precedes that terminal event. All of that is a
handful of per-order minima: one hash aggregate with map-side partial
aggregation, so a hot order is pre-combined before the shuffle. Ties in ts
follow the kind name (FAILED < PAID < PAY_FAILED < VALIDATED), the same
total order (ts, kind) the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (PAYMENT_DECLINED_REASON, STATUS_COMPLETED, STATUS_FAILED,
                                 STATUS_PAYMENT_FAILED, STATUS_PENDING, STATUS_VALIDATED, compensation_reason,
                                 fmt_ts, status_message)

PAY_KINDS = ("PAID", "PAY_FAILED")


def status_summary(log: DataFrame, placed: DataFrame) -> DataFrame:
    """Per placed order: placement time, first validation, terminal status and time."""
    kind, ts = F.col("kind"), F.col("ts")
    placed = placed.select("order_number", F.col("ts").alias("placed_ts"))
    # an order that is not placed yet is not found: its earlier events are ignored
    known = placed.join(log, "order_number").where(ts >= F.col("placed_ts"))
    agg = known.groupBy("order_number").agg(
        F.min(F.when(kind == "VALIDATED", ts)).alias("v_ts"),
        F.min(F.when(kind == "FAILED", ts)).alias("f_ts"),
        F.min(F.when(kind.isin(*PAY_KINDS), ts)).alias("p_ts"),
        F.min_by(kind, F.when(kind.isin(*PAY_KINDS), F.struct(ts, kind))).alias("p_kind"))
    j = placed.join(agg, "order_number", "left")
    v, f, p = F.col("v_ts"), F.col("f_ts"), F.col("p_ts")
    fail_wins = f.isNotNull() & (v.isNull() | (f <= v)) & (p.isNull() | (f <= p))
    term_status = (F.when(fail_wins, F.lit(STATUS_FAILED))
                   .when(p.isNotNull(), F.when(F.col("p_kind") == "PAID", F.lit(STATUS_COMPLETED))
                         .otherwise(F.lit(STATUS_PAYMENT_FAILED))))
    term_ts = F.when(fail_wins, f).otherwise(p)
    return j.select("order_number", "placed_ts", "v_ts", term_status.alias("term_status"), term_ts.alias("term_ts"))


def final_status(summary: DataFrame) -> DataFrame:
    """status of every order after its whole event log."""
    status = F.coalesce(F.col("term_status"),
                        F.when(F.col("v_ts").isNotNull(), F.lit(STATUS_VALIDATED)).otherwise(F.lit(STATUS_PENDING)))
    return summary.select("order_number", status.alias("status"))


def transitions(summary: DataFrame) -> DataFrame:
    """One row per accepted transition (PENDING at placement, then
    VALIDATED when it came before the terminal event, then the terminal)."""
    v_ok = F.col("v_ts").isNotNull() & (F.col("term_ts").isNull() | (F.col("v_ts") < F.col("term_ts")))
    steps = F.array(
        F.struct(F.lit(STATUS_PENDING).alias("status"), F.col("placed_ts").alias("ts")),
        F.when(v_ok, F.struct(F.lit(STATUS_VALIDATED).alias("status"), F.col("v_ts").alias("ts"))),
        F.when(F.col("term_status").isNotNull(),
               F.struct(F.col("term_status").alias("status"), F.col("term_ts").alias("ts"))))
    e = summary.select("order_number", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("t"))
    return e.select("order_number", "t.status", "t.ts")


def orders_processed(trans: DataFrame) -> DataFrame:
    """Processed-order counters. ``failed`` counts inventory failures
    only (PAYMENT_FAILED is not counted), as the reference's counter does."""
    one = trans.agg(F.sum(F.when(F.col("status") == STATUS_COMPLETED, 1).otherwise(0)).cast("bigint").alias("c"),
                    F.sum(F.when(F.col("status") == STATUS_FAILED, 1).otherwise(0)).cast("bigint").alias("f"))
    return one.select(F.explode(F.array(
        F.struct(F.lit("completed").alias("status"), F.coalesce("c", F.lit(0)).cast("bigint").alias("n")),
        F.struct(F.lit("failed").alias("status"), F.coalesce("f", F.lit(0)).cast("bigint").alias("n")))).alias("x")
    ).select("x.*")


def payment_gate(payments: DataFrame, trans: DataFrame) -> DataFrame:
    """A payment joined with the order's status *at its arrival* (the
    latest transition strictly before it); kept when PENDING or VALIDATED;
    no status (unknown order) -> dropped.

    As-of join as equi-join on the order + time filter + ``max_by`` per
    payment. A transition list per order has at most three rows, so the join
    emits at most three rows per payment: a proven bound, not a pair
    explosion; AQE splits a skewed order's partition.
    """
    p = payments.select("order_number", "payment_id", F.col("ts").alias("pay_ts"))
    t = trans.select("order_number", F.col("ts").alias("t_ts"), "status")
    j = p.join(t, "order_number").filter(F.col("t_ts") < F.col("pay_ts"))
    # transitions of one instant follow the machine's order
    rank = F.when(F.col("status") == STATUS_PENDING, 0).when(F.col("status") == STATUS_VALIDATED, 1).otherwise(2)
    at = (j.groupBy("order_number", "payment_id", "pay_ts")      # a payment is told apart by its id, not by its time
          .agg(F.max_by("status", F.struct("t_ts", rank)).alias("status_at_arrival")))
    return (at.filter(F.col("status_at_arrival").isin(STATUS_PENDING, STATUS_VALIDATED))
            .select("order_number", "payment_id", fmt_ts(F.col("pay_ts")).alias("paid_at"), "status_at_arrival"))


def restock_compensation(trans: DataFrame, lines: DataFrame) -> DataFrame:
    """An *accepted* payment failure gives every line's quantity back."""
    pf = trans.filter(F.col("status") == STATUS_PAYMENT_FAILED).select("order_number")
    j = lines.join(pf, "order_number", "left_semi")
    return j.select("order_number", "sku", F.col("qty").cast("int").alias("adjustment_quantity"),
                    compensation_reason(F.col("order_number")).alias("reason"), "l_linenumber", "l_suppkey")


def orphan_events(log: DataFrame, placed: DataFrame) -> DataFrame:
    """Events that refer to no existing order (left anti join)."""
    return (log.join(placed.select("order_number"), "order_number", "left_anti")
            .select("order_number", "kind", fmt_ts(F.col("ts")).alias("ts")))


def notification_feed(placed: DataFrame, log: DataFrame, failures: DataFrame) -> DataFrame:
    """Four topics -> one (order, status, message) feed.

    order placed -> PENDING; payment processed -> COMPLETED; order failed
    (the gather's events, with their reason) -> FAILED; payment failed ->
    PAYMENT_FAILED. The listener does not look the order up, so events of
    unknown orders are notified too.
    """
    a = placed.select("order_number", F.lit(STATUS_PENDING).alias("status"), F.lit(None).cast("string").alias("r"))
    b = log.filter(F.col("kind") == "PAID").select("order_number", F.lit(STATUS_COMPLETED).alias("status"),
                                                   F.lit(None).cast("string").alias("r"))
    c = failures.select("order_number", F.lit(STATUS_FAILED).alias("status"), F.col("reason").alias("r"))
    d = log.filter(F.col("kind") == "PAY_FAILED").select(
        "order_number", F.lit(STATUS_PAYMENT_FAILED).alias("status"), F.lit(PAYMENT_DECLINED_REASON).alias("r"))
    u = a.unionByName(b).unionByName(c).unionByName(d)
    return u.select("order_number", "status", status_message(F.col("status"), F.col("r")).alias("message"))

