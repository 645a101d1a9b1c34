"""Properties over the driver tables."""
from pyspark.sql import functions as F

from conftest import SF001
from emporia.operators import reservation as R
from emporia.operators import stock as ST
from emporia.operators import status as S
from emporia.plans import fixtures as FX
from emporia.plans.registry import _changes


def test_stock_never_negative_and_running_equals_final(spark):
    run = ST.stock_running(_changes(spark, SF001))
    assert run.filter(F.col("stock") < 0).count() == 0
    last = (run.groupBy("sku").agg(F.max_by("stock", F.struct(*ST.CHANGE_ORDER)).alias("s")))
    lvl = ST.stock_level(_changes(spark, SF001))
    assert last.join(lvl, "sku").filter(F.col("s") != F.col("stock")).count() == 0


def test_granted_never_exceeds_opening(spark):
    res = R.reserve(FX.lines(spark, SF001), opening=FX.opening(spark, SF001))
    granted = res.filter("success").groupBy("sku").agg(F.sum("qty").alias("g"))
    bad = granted.join(FX.opening(spark, SF001), "sku", "left").filter(
        F.col("g") > F.coalesce(F.col("stock"), F.lit(0)))
    assert bad.count() == 0
    assert res.count() == FX.lines(spark, SF001).count()


def test_one_status_per_order_and_closed_form_equals_fold(spark):
    log = FX.status_log(spark, SF001)
    placed = FX.placed(spark, SF001)
    fs = {r.order_number: r.status for r in S.final_status(S.status_summary(log, placed)).collect()}
    assert len(fs) == placed.count()
    rows = sorted(log.collect(), key=lambda r: (r.order_number, r.ts, r.kind))
    state = {k: "PENDING" for k in fs}
    nxt = {("VALIDATED", "PENDING"): "VALIDATED", ("FAILED", "PENDING"): "FAILED",
           ("PAID", "PENDING"): "COMPLETED", ("PAID", "VALIDATED"): "COMPLETED",
           ("PAY_FAILED", "PENDING"): "PAYMENT_FAILED", ("PAY_FAILED", "VALIDATED"): "PAYMENT_FAILED"}
    for r in rows:
        if r.order_number in state:
            state[r.order_number] = nxt.get((r.kind, state[r.order_number]), state[r.order_number])
    assert state == fs
