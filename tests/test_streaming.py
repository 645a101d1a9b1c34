"""Streams: slices staged in parallel, restart, expiry, state that is freed."""
import datetime as dt
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from emporia.operators import stock as ST
from emporia.plans.registry import _changes
from emporia.session import scratch_path, session_conf
from emporia.streaming import jobs as J
from emporia.streaming import processors as P
from emporia.streaming.harness import Staged, drain, latest_per_key, read_output

T0 = dt.datetime(2024, 1, 1)
MIN = dt.timedelta(minutes=1)


def test_failure_between_sink_and_commit_and_replay_match_batch(spark):
    """The interrupted batch is replayed under its number; running again
    with nothing new changes nothing."""
    changes, out, ckpt = _changes(spark, SF001), scratch_path(spark, "j8-out"), scratch_path(spark, "j8-ckpt")
    staged, seen = Staged(changes, "j8", slices=3), []

    def fail_once(batch_id):
        seen.append(batch_id)
        if seen.count(1) == 1 and batch_id == 1:
            raise RuntimeError("stop here")

    with pytest.raises(Exception, match="stop here"):
        drain(staged, J.stream_stock, "j8", "update", checkpoint=ckpt, out=out, on_written=fail_once)
    done = latest_per_key(drain(staged, J.stream_stock, "j8", "update", checkpoint=ckpt, out=out, on_written=fail_once), ["sku"])
    batch = ST.stock_level(changes).select("sku", "stock")
    assert done.exceptAll(batch).count() == 0 and batch.exceptAll(done).count() == 0
    assert seen.count(1) == 2      # written twice, once in the table
    n = read_output(spark, out, None).select("batch_id").distinct().count()
    drain(staged, J.stream_stock, "j8", "update", checkpoint=ckpt, out=out)
    assert read_output(spark, out, None).select("batch_id").distinct().count() == n == 3


def test_slices_are_written_by_several_tasks_in_time_order(spark):
    rows = spark.range(4000, numPartitions=4).select((F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7 % 4000).cast("int"))).alias("ts"))
    staged = Staged(rows, "slices", slices=4)
    assert len(staged.waiting) == 4
    files = [[f for f in os.listdir(f"{staged.path}/waiting/{w}") if f.endswith(".parquet")] for w in staged.waiting]
    assert all(len(f) == 4 for f in files)
    spans = [spark.read.parquet(f"{staged.path}/waiting/{w}").agg(F.min("ts"), F.max("ts"), F.count("*")).first() for w in staged.waiting]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and min(s[2] for s in spans) > 800


def test_slices_begin_where_another_table_says(spark):
    """The rows are then computed once, for the write; their order holds all the same."""
    at = lambda n: spark.range(n).select((F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    staged = Staged(at(400), "times", slices=4, times=at(40))
    spans = [spark.read.parquet(f"{staged.path}/waiting/{w}").agg(F.min("ts"), F.max("ts"), F.count("*")).first() for w in staged.waiting]
    assert [s[2] for s in spans] == [spans[0][2], 10, 10, 400 - 20 - spans[0][2]] and spans[0][2] in (10, 11)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_events_without_a_sku_stay_where_they_are(spark):
    """Half of an order's events have no SKU: looking them up would send all of them to one task."""
    events = spark.range(4000, numPartitions=4).select(
        F.col("id").cast("string").alias("order_number"), F.lit(P.LINE).alias("rank"), F.lit(T0).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("S"), (F.col("id") % 20).cast("string"))).alias("sku"))
    feed = spark.createDataFrame([(f"S{i}", T0 + (i % 3 - 1) * MIN) for i in range(0, 18, 2)], "sku string, ts timestamp_ntz")
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        rows = J._known(events, feed).select("order_number", "known", F.spark_partition_id().alias("task")).collect()
    assert {int(r.order_number): r.known for r in rows} == {i: i % 2 == 0 and i % 20 < 18 and i % 20 % 3 < 2 for i in range(4000)}
    odd = [r.task for r in rows if int(r.order_number) % 2]
    assert max(odd.count(t) for t in set(odd)) == 500


class _State:
    """What a processor keeps, and the timers it sets."""

    def __init__(self):
        self.v, self.map = None, {}

    def get(self):
        return self.v

    def exists(self):
        return self.v is not None

    def update(self, v):
        self.v = v

    def clear(self):
        self.v, self.map = None, {}

    def containsKey(self, k):
        return k in self.map

    def updateValue(self, k, v):
        self.map[k] = v


class _Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _State())

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, _State())

    def registerTimer(self, ms):
        self.timers.append(ms)


def run(processor, *batches):
    """(outputs of each batch, handle) of one key's micro-batches."""
    h = _Handle()
    processor.init(h)
    return [list(processor.handleInputRows(("k",), iter(b), None)) for b in batches], h


def placed(at, n):
    return SimpleNamespace(at=at, side=0, total_items=n)


def result(at, line, ok=True):
    return SimpleNamespace(at=at, side=1, l_linenumber=line, l_partkey=line, l_suppkey=1, qty=1, sku=f"S{line}", success=ok,
                           reason=None if ok else f"no {line}")


def outcomes(batches):
    return [(r.outcome, r.reason) for b in batches for r in b]


def test_saga_expires_from_placement_and_is_cleared_on_completion():
    out, h = run(P.Gather(), [placed(T0, 2), result(T0 + MIN, 1)], [result(T0 + 2 * MIN, 2), result(T0 + MIN, 1)])
    assert outcomes(out) == [("PENDING", None), ("VALIDATED", None)]
    assert h.states["saga"].v is None and h.states["seen"].map == {}
    assert h.timers == [int((T0 + 10 * MIN).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)]
    out, _ = run(P.Gather(), [placed(T0, 2), result(T0 + MIN, 1)], [result(T0 + 10 * MIN, 2)])
    assert outcomes(out)[-1] == ("VALIDATED", None)      # exactly at the end it is still there
    out, h = run(P.Gather(), [placed(T0, 2), result(T0 + MIN, 1)], [result(T0 + 10 * MIN + MIN / 60, 2)])
    assert outcomes(out) == [("PENDING", None)] and h.states["saga"].v is None


def test_saga_fails_once_also_after_it_expired():
    out, _ = run(P.Gather(), [placed(T0, 3), result(T0 + MIN, 1, False), result(T0 + MIN, 2, False)], [result(T0 + 2 * MIN, 3)])
    assert outcomes(out) == [("PENDING", None), ("FAILED", "no 1")]
    out, _ = run(P.Gather(), [placed(T0, 3)], [result(T0 + 11 * MIN, 1, False), result(T0 + 12 * MIN, 2, False)])
    assert outcomes(out) == [("PENDING", None), ("FAILED", "no 1")]


def test_timers_free_state_but_not_that_of_a_newer_record():
    p = P.Gather()
    _, h = run(p, [placed(T0, 3)])
    info = SimpleNamespace(getExpiryTimeInMs=lambda: h.timers[0])
    assert list(p.handleExpiredTimer(("k",), None, info)) == [] and h.states["saga"].v is None
    p = P.CartSessions()
    add = lambda at, i: SimpleNamespace(at=at, event_id=i, kind="add", qty=2)
    out, h = run(p, [add(T0, 1)], [add(T0 + 20 * 60 * MIN, 2)])
    p.handleExpiredTimer(("k",), None, SimpleNamespace(getExpiryTimeInMs=lambda: h.timers[0]))
    assert h.states["cart"].v is not None      # renewed since
    p.handleExpiredTimer(("k",), None, SimpleNamespace(getExpiryTimeInMs=lambda: h.timers[1]))
    assert h.states["cart"].v is None
    assert [(r.cart_no, r.n_adds, r.qty, r.session_end) for b in out for r in b][-1] == (1, 2, 4, T0 + 44 * 60 * MIN)


def test_the_first_event_wins_however_late_the_replay():
    row = lambda day, attempt: SimpleNamespace(ts=T0 + dt.timedelta(day), attempt=attempt)
    out, _ = run(P.FirstWins(), [row(5, 1), row(5, 0)], [row(6, 2)], [row(500, 3)])
    assert [[(r.ts, r.attempt) for r in b] for b in out] == [[(T0 + dt.timedelta(5), 0)], [], []]


def test_an_order_with_an_unknown_product_never_exists():
    ev = lambda kind, rank, at=T0, known=None, pid=None: SimpleNamespace(at=at, rank=rank, kind=kind, known=known, payment_id=pid)
    lost = [ev("PLACED", P.PLACED), ev("LINE", P.LINE, known=True), ev("LINE", P.LINE, known=False)]
    later = [ev("PAYMENT", P.PAYMENT, T0 + MIN, pid="p"), ev("PAID", P.EVENT, T0 + MIN)]
    assert run(P.StatusMachine(), lost, later)[0] == [[], []] and run(P.PaymentGate(), lost, later)[0] == [[], []]
    found = [ev("PLACED", P.PLACED), ev("LINE", P.LINE, known=True)]
    assert [[r.status for r in b] for b in run(P.StatusMachine(), found, later)[0]] == [["PENDING"], ["COMPLETED"]]
    assert [(r.payment_id, r.status_at_arrival) for b in run(P.PaymentGate(), found, later)[0] for r in b] == [("p", "PENDING")]


def test_changes_and_requests_without_a_sku_touch_no_state():
    row = lambda **x: SimpleNamespace(ts=T0, l_orderkey=1, l_linenumber=1, l_suppkey=1, order_number="o", **x)
    out, h = run(P.StockFold(), [row(sku=None, chg=5)])
    assert out == [[]] and h.states["stock"].v is None
    out, h = run(P.ReserveFold(), [row(sku=None, kind=1, amount=5), row(sku="A", kind=0, amount=None)])
    assert out == [[]] and h.states["stock"].v is None
