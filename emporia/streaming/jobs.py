"""Streaming jobs (J1-J9, A1, G4), registered next to the batch jobs.

Each job is ``transform(streaming DataFrame) -> streaming DataFrame``; the
registered query stages the raw events of the driver tables, drains the stream
slice by slice and returns the sink table, so its result can be compared with
the batch form and the oracle. No batch result is staged as an input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (PAYMENT_DECLINED_REASON, STATUS_COMPLETED, STATUS_FAILED, STATUS_PAYMENT_FAILED, STATUS_PENDING, fmt_ts,
                                 not_enough_stock_reason, status_message)
from ..operators import orders as O
from ..operators import reservation as R
from ..plans import fixtures as FX
from ..plans.fixtures_sql import with_ctes
from ..plans.registry import (CART_SESSIONS_SQL, NOTIFY_SQL, ORACLES, _changes, _ctes_sql, _CHANGES, _payments, _placed_with_replays,
                              _REQ, _walk_sql, register)
from ..plans.skew import asof_join, validity
from ..session import scratch_path
from ..sources.sinks import create_table, read_table, upsert_sink
from ..sources.tables import table
from . import processors as P
from .grouped import per_key
from .harness import Staged, drain, latest_per_key, run_once


# --- transforms (streaming DataFrame -> streaming DataFrame) -----------------

def _event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``at`` (the event's wall-clock time, for the processors) and a watermark
    on the same instant, which must be a zoned timestamp."""
    return events.withColumn("at", F.col(ts)).withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", "0 seconds")


def stream_stock(changes: DataFrame) -> DataFrame:
    """Clamped stock per SKU, re-keyed by SKU."""
    return per_key(changes, "sku", P.StockFold(), P.STOCK_OUT, "Update")


def stream_reservation(unified: DataFrame) -> DataFrame:
    """Reservation sharing the stock state with the change fold."""
    return per_key(unified, "sku", P.ReserveFold(), P.RESERVE_OUT)


def stream_outcome(events: DataFrame) -> DataFrame:
    """Placements (side 0) and line results (side 1) gathered per order; a
    saga record expires in event time."""
    return per_key(_event_time(events), "order_number", P.Gather(), P.GATHER_OUT, event_time=True)


def _decisive(events: DataFrame) -> DataFrame:
    """The events that the status machine acts on, with ``at``: a line whose
    product is known changes nothing and is not sent to it."""
    return events.where(~F.coalesce((F.col("rank") == P.LINE) & F.col("known"), F.lit(False))).withColumn("at", F.col("ts"))


def stream_payment_gate(events: DataFrame) -> DataFrame:
    """Payments against the status that the order's own events give."""
    return per_key(_decisive(events), "order_number", P.PaymentGate(), P.GATE_OUT)


def stream_status(events: DataFrame) -> DataFrame:
    """Status machine, one output row per accepted transition."""
    return per_key(_decisive(events), "order_number", P.StatusMachine(), P.MACHINE_OUT)


def stream_cart_sessions(ev: DataFrame, feed: DataFrame) -> DataFrame:
    """Carts per user; adds look their product up in the cache as of their
    time (stream-static join) and are refused if it has none."""
    held = validity(feed, "sku", "ts", ["seq"]).select("sku", F.lit(True).alias("_found"), "_since", "_until")
    adds = asof_join(ev.where(F.col("kind") == "add"), held, "sku", "ts", {}, how="inner").drop("_found")
    both = adds.unionByName(ev.where(F.col("kind") == "checkout"))
    return per_key(_event_time(both), "user_id", P.CartSessions(), P.SESSION_OUT, "Update", event_time=True)


def stream_dedup_first(placed: DataFrame) -> DataFrame:
    """G4 streaming: the first event of a unique key wins, however late a replay comes."""
    out = ", ".join(f"{n} {t}" for n, t in placed.dtypes)
    return per_key(placed, "order_number", P.FirstWins(), out)


def stream_notifications(placed: DataFrame, log: DataFrame, gather: DataFrame) -> DataFrame:
    """Four topics fanned into one feed; the failed topic is the output of
    the gather in the same query."""
    none = F.lit(None).cast("string")
    row = lambda df, status, r=none: df.select("order_number", F.lit(status).alias("status"), r.alias("r"))
    failed = stream_outcome(gather).where(F.col("outcome") == STATUS_FAILED)
    u = (row(placed, STATUS_PENDING).unionByName(row(log.where("kind = 'PAID'"), STATUS_COMPLETED))
         .unionByName(row(failed, STATUS_FAILED, F.col("reason")))
         .unionByName(row(log.where("kind = 'PAY_FAILED'"), STATUS_PAYMENT_FAILED, F.lit(PAYMENT_DECLINED_REASON))))
    return u.select("order_number", "status", status_message(F.col("status"), F.col("r")).alias("message"))


# --- events of the driver tables ----------------------------------------------

def _gather_events(spark, sf) -> DataFrame:
    """Placements (side 0) and line results (side 1)."""
    res = FX.results(spark, sf).select("order_number", "ts", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("total_items"),
                                       "l_linenumber", "l_partkey", "l_suppkey", "qty", "sku", "success", "reason")
    none = [F.lit(None).cast(res.schema[c].dataType).alias(c) for c in res.columns[4:]]
    saga = FX.order_items(spark, sf).select("order_number", F.col("created").alias("ts"), F.lit(0).alias("side"), "total_items", *none)
    return saga.unionByName(res)


def _order_events(spark, sf) -> DataFrame:
    """Raw events of the orders: lines, placements, results' and payments' topics."""
    def rows(df: DataFrame, kind: Column, rank: int, sku: Column | None = None) -> DataFrame:
        return df.select("order_number", kind.alias("kind"), "ts", F.lit(rank).alias("rank"),
                         (sku if sku is not None else F.lit(None).cast("string")).alias("sku"))
    return (rows(FX.lines(spark, sf), F.lit("LINE"), P.LINE, F.col("sku")).unionByName(rows(FX.placed(spark, sf), F.lit("PLACED"), P.PLACED))
            .unionByName(rows(FX.status_log(spark, sf), F.col("kind"), P.EVENT)))


def _known(events: DataFrame, feed: DataFrame) -> DataFrame:
    """D2 on the stream: whether the cache holds a line's product at that time.
    Events without a SKU are not looked up: a join would send all of them to one task."""
    looked_up = (events.where("sku IS NOT NULL").join(O.first_seen(feed), "sku", "left")
                 .withColumn("known", F.coalesce(F.col("known_from") <= F.col("ts"), F.lit(False))).drop("known_from", "sku"))
    return looked_up.unionByName(events.where("sku IS NULL").drop("sku").withColumn("known", F.lit(False)))


# --- registered runs ---------------------------------------------------------

@register("stream_events_scan", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def q_stream_events_scan(spark, sf):
    """A1: topic scan from the earliest offset in bounded polls: the events
    arrive as ordered slices and each run takes one, so the running count is
    carried in state from run to run."""
    count = lambda src: src.groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return latest_per_key(drain(Staged(table(spark, sf, "events"), "events"), count, "events_scan", "update"), ["event_type"])


@register("stream_dedup_orders", ORACLES["dedup_orders"])
def q_stream_dedup_orders(spark, sf):
    """G4 streaming: replays arrive between originals."""
    out = drain(Staged(_placed_with_replays(spark, sf), "placed", slices=3), stream_dedup_first, "dedup")
    return out.select("order_number", "user_id", fmt_ts(F.col("ts")).alias("ts"), "attempt")


@register("stream_stock", with_ctes("SELECT sku, stock FROM stock_final", "stock_final"))
def q_stream_stock(spark, sf):
    return latest_per_key(drain(Staged(_changes(spark, sf), "changes"), stream_stock, "stream_stock", "update"), ["sku"])


@register("stream_stock_lookup", with_ctes("SELECT sku, stock AS quantity FROM stock_final", "stock_final"))
def q_stream_stock_lookup(spark, sf):
    """Read the current stock straight from the stream's state store."""
    ckpt = scratch_path(spark, "stream_stock-ckpt")
    drain(Staged(_changes(spark, sf), "changes"), stream_stock, "stream_stock", "update", checkpoint=ckpt)
    group = F.col("value.groupState") if "groupState" in (st := spark.read.format("statestore").load(ckpt)).schema["value"].dataType.names else F.col("value")
    kept = st.select(F.explode(F.arrays_zip(group["stock_at"].alias("at"), group["stock_stock"].alias("stock"))).alias("s"), group["keys"].alias("keys"))
    return kept.select(F.col("keys")[F.col("s.at")].alias("sku"), F.col("s.stock").cast("bigint").alias("quantity"))


class Interrupted(RuntimeError):
    """The failure that ``stream_restart`` injects."""


@register("stream_restart", with_ctes("SELECT sku, stock FROM stock_final", "stock_final"))
def q_stream_restart(spark, sf):
    """The stream fails after a batch has reached the sink and before it is
    committed, is started again from its checkpoint, and ends as if nothing had
    been: the batch is replayed under its number and replaces its own rows."""
    out, ckpt = scratch_path(spark, "restart-out"), scratch_path(spark, "restart-ckpt")
    staged, failed = Staged(_changes(spark, sf), "changes", slices=3), []

    def fail_once(batch_id: int) -> None:
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise Interrupted("between sink and commit")

    while True:
        try:
            done = drain(staged, stream_stock, "restart", "update", checkpoint=ckpt, out=out, on_written=fail_once)
        except Exception as e:
            if "between sink and commit" not in str(e):
                raise
            continue      # the slice is published: the next run replays it
        return latest_per_key(done, ["sku"])


@register("stream_reservation", _ctes_sql(_walk_sql(f"{_REQ} UNION ALL {_CHANGES}"), "lines", "changes"))
def q_stream_reservation(spark, sf):
    u = R._unified(_changes(spark, sf), None, FX.lines(spark, sf))
    out = drain(Staged(u, "reserve"), stream_reservation, "stream_reservation")
    return out.select("order_number", "sku", "qty", fmt_ts(F.col("ts")).alias("ts"), "l_orderkey", "l_linenumber",
                      "l_suppkey", "success",
                      F.when(~F.col("success"), not_enough_stock_reason(F.col("sku"), F.col("qty"),
                                                                        F.col("stock_before"))).alias("reason"),
                      "stock_after")


@register("stream_outcome", with_ctes("SELECT order_number, outcome, reason FROM outcome", "outcome"))
def q_stream_outcome(spark, sf):
    """The decisive event of every order, from the gather's events."""
    out = drain(Staged(_gather_events(spark, sf), "gather"), stream_outcome, "stream_outcome")
    decided = F.struct((F.col("outcome") == STATUS_PENDING).alias("open"), "ts", "outcome")
    return (out.groupBy("order_number").agg(F.min_by(F.struct("outcome", "reason"), decided).alias("r"))
            .select("order_number", "r.*"))


@register("stream_payment_gate", ORACLES["payment_gate"])
def q_stream_payment_gate(spark, sf):
    events, feed = _order_events(spark, sf).withColumn("payment_id", F.lit(None).cast("string")), FX.product_feed(spark, sf)
    pay = _payments(spark, sf).select("order_number", F.lit("PAYMENT").alias("kind"), "ts", F.lit(P.PAYMENT).alias("rank"),
                                      F.lit(None).cast("string").alias("sku"), "payment_id")
    staged = Staged(events.unionByName(pay), "gate", times=FX.placed(spark, sf))
    out = drain(staged, lambda s: stream_payment_gate(_known(s, feed)), "stream_gate")
    return out.select("order_number", "payment_id", fmt_ts(F.col("pay_ts")).alias("paid_at"), "status_at_arrival")


@register("stream_status", ORACLES["status_transitions"])
def q_stream_status(spark, sf):
    feed = FX.product_feed(spark, sf)
    staged = Staged(_order_events(spark, sf), "status", times=FX.placed(spark, sf))
    out = drain(staged, lambda s: stream_status(_known(s, feed)), "stream_status")
    return out.select("order_number", "status", fmt_ts(F.col("ts")).alias("ts"))


@register("stream_cart_sessions", CART_SESSIONS_SQL)
def q_stream_cart_sessions(spark, sf):
    """J5 streaming: every cart with the end it has, open ones included."""
    ev, feed = FX.cart_ev(spark, sf), FX.product_feed(spark, sf)
    out = drain(Staged(ev.where(F.col("kind") != "remove"), "cart"), lambda s: stream_cart_sessions(s, feed), "stream_sessions", "update")
    return latest_per_key(out, ["user_id", "cart_no"]).select(
        "user_id", fmt_ts(F.col("session_start")).alias("session_start"), fmt_ts(F.col("session_end")).alias("session_end"),
        "checked_out", "n_adds", "qty")


@register("stream_notification_feed", with_ctes(NOTIFY_SQL, "placed", "status_log", "failure_events"))
def q_stream_notification_feed(spark, sf):
    """Four topic streams fanned into one (order, status, message) feed."""
    staged = [Staged(FX.placed(spark, sf), "placed", slices=2), Staged(FX.status_log(spark, sf), "log", slices=2),
              Staged(_gather_events(spark, sf), "gather", slices=2)]
    return drain(staged, stream_notifications, "notify").select("order_number", "status", "message")


@register("stream_upsert", ORACLES["upsert_latest"])
def q_stream_upsert(spark, sf):
    """A7 as a stream sink: the newest rows arrive first, late old ones change nothing."""
    feed = FX.product_feed(spark, sf).select("sku", "seq", "name", "price", (-F.col("seq")).alias("age"))
    path, ckpt = scratch_path(spark, "stream_table"), scratch_path(spark, "stream_table-ckpt")
    create_table(feed.limit(0).drop("age"), "sku", path)
    staged = Staged(feed, "feed", "age", slices=3)
    while staged.publish():
        run_once(staged.stream().drop("age"), path, ckpt, sink=upsert_sink(path, "sku", "seq"))
    return read_table(spark, path)
