"""Null quantities and keys stay out of the folds; events of an order that is
not placed yet are ignored; every event and line reaches a job."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from emporia.operators import reservation as R
from emporia.operators import status as S
from emporia.operators import stock as ST
from emporia.plans import fixtures as FX
from emporia.plans.registry import _changes
from emporia.streaming.harness import read_output

T0 = dt.datetime(2024, 1, 1)
CHANGE = "sku string, chg long, ts timestamp_ntz, l_orderkey long, l_linenumber int, l_suppkey long"


def _at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_a_null_quantity_leaves_the_stock_alone(spark):
    rows = [("A", 5, _at(0), 1, 1, 1), ("A", None, _at(1), 2, 1, 1), (None, 7, _at(2), 3, 1, 1), ("B", 2, _at(0), 4, 1, 1)]
    changes = spark.createDataFrame(rows, CHANGE)
    assert {r.sku: (r.stock, r.n_changes) for r in ST.stock_level(changes).collect()} == {"A": (5, 1), "B": (2, 1)}
    assert sorted((r.sku, r.stock) for r in ST.stock_running(changes).collect()) == [("A", 5), ("B", 2)]
    bad = {(r.l_orderkey, r.error) for r in ST.unfoldable(changes).collect()}
    assert {k for k, _ in bad} == {2, 3} and len({e for _, e in bad}) == 2


def test_a_null_request_does_not_end_the_reservation(spark):
    req = spark.createDataFrame([("1", "A", None, _at(0), 1, 1, 1), ("2", "A", 3, _at(1), 2, 1, 1)],
                                "order_number string, sku string, qty int, ts timestamp_ntz, l_orderkey long, l_linenumber int, l_suppkey long")
    opening = spark.createDataFrame([("A", 4), ("B", None)], "sku string, stock long")
    got = sorted((r.order_number, r.success, r.stock_after) for r in R.reserve(req, opening=opening).collect())
    assert got == [("1", False, None), ("2", True, 1)]      # refused, not lost


def test_a_missing_initial_quantity_is_not_zero(spark):
    from emporia.functions.scalars import floor_zero
    got = [r[0] for r in spark.createDataFrame([(None,), (-3,), (4,)], "q long").select(floor_zero(F.col("q"))).collect()]
    assert got == [None, 0, 4]


def test_events_before_placement_are_ignored(spark):
    placed = spark.createDataFrame([("1", _at(5)), ("2", _at(0))], "order_number string, ts timestamp_ntz")
    log = spark.createDataFrame([("1", "FAILED", _at(1)), ("2", "FAILED", _at(1)), ("9", "PAID", _at(1))],
                                "order_number string, kind string, ts timestamp_ntz")
    got = {r.order_number: r.status for r in S.final_status(S.status_summary(log, placed)).collect()}
    assert got == {"1": "PENDING", "2": "FAILED"}


def test_transitions_of_one_instant_follow_the_machine(spark):
    trans = spark.createDataFrame([("1", "PENDING", _at(0)), ("1", "VALIDATED", _at(0)), ("1", "COMPLETED", _at(9))],
                                  "order_number string, status string, ts timestamp_ntz")
    pay = spark.createDataFrame([("1", "p", _at(3))], "order_number string, payment_id string, ts timestamp_ntz")
    assert [r.status_at_arrival for r in S.payment_gate(pay, trans).collect()] == ["VALIDATED"]


def test_no_event_or_line_is_left_out(spark):
    n = FX.table(spark, SF001, "events").where("event_type in ('click', 'error', 'purchase')").count()
    assert FX.cart_ev(spark, SF001).count() == n
    assert FX.user_patch(spark, SF001).count() == FX.table(spark, SF001, "events").count()
    assert _changes(spark, SF001).count() == FX.table(spark, SF001, "lineitem").count() + FX.table(spark, SF001, "part").count()


def test_only_a_missing_output_reads_as_empty(spark, tmp_path):
    assert read_output(spark, f"{tmp_path}/none", spark.range(1).schema).count() == 0
    (tmp_path / "broken" / "batch_id=0").mkdir(parents=True)
    (tmp_path / "broken" / "batch_id=0" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_output(spark, f"{tmp_path}/broken", spark.range(1).schema).count()
