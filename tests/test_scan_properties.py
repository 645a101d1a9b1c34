"""Property tests of the skew-safe scans against a plain sequential fold."""
import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from emporia.plans.scan import clamped_final, clamped_running

LO, HI = 0, 1000   # a small upper bound so both clamps are hit often

rows_st = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-700, 700)), min_size=0, max_size=60)
parts_st = st.integers(1, 6)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _fold(rows):
    by = defaultdict(list)
    for seq, (k, c) in enumerate(rows):
        by[k].append((seq, c))
    clamp, final = {}, {}
    for k, rs in by.items():
        v = 0
        for seq, c in rs:
            v = min(HI, max(LO, v + c))
            clamp[seq] = v
        final[k] = (v, len(rs))
    return clamp, final


@SETTINGS
@given(rows=rows_st, parts=parts_st)
def test_clamped_scans_equal_sequential_fold(spark, rows, parts):
    df = spark.createDataFrame([(k, i, c) for i, (k, c) in enumerate(rows)], "k string, seq long, c long")
    clamp, final = _fold(rows)
    got = {r.seq: r.v for r in clamped_running(df, ["k"], ["seq"], "c", LO, HI, out_col="v",
                                                partitions=parts).collect()}
    assert got == clamp
    got_f = {r.k: (r.v, r.n) for r in clamped_final(df, ["k"], ["seq"], "c", LO, HI, out_col="v",
                                                      partitions=parts).collect()}
    assert got_f == final


@SETTINGS
@given(ops=st.lists(st.tuples(st.sampled_from(["A", "A", "A", "B", "C"]), st.booleans(), st.integers(-5, 40)),
                    max_size=60),
       parts=st.integers(1, 5))
def test_reservation_equals_sequential_fold(spark, ops, parts):
    """F1 interleaved: per SKU in (ts, kind) order a change clamps into
    [0, 2^31-1], a request is granted iff stock >= qty (negative qty raises)."""
    from emporia.functions.scalars import INT_MAX
    from emporia.operators import reservation as R
    t0 = dt.datetime(2024, 1, 1)
    changes, requests = [], []
    for i, (sku, is_change, v) in enumerate(ops):
        ts = t0 + dt.timedelta(minutes=i)
        if is_change:
            changes.append((sku, v, ts, i, 0, 0))
        else:
            requests.append((f"o{i}", sku, v, ts, i, 1, 1, 1))
    ch = spark.createDataFrame(changes, "sku string, chg long, ts timestamp_ntz, l_orderkey long, "
                                        "l_linenumber int, l_suppkey long")
    rq = spark.createDataFrame(requests, "order_number string, sku string, qty int, ts timestamp_ntz, "
                                         "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    got = {r.order_number: (r.success, r.stock_after)
           for r in R.reserve(rq, changes=ch, partitions=parts).collect()}
    stock, exp = {}, {}
    for i, (sku, is_change, v) in enumerate(ops):
        s = stock.get(sku, 0)
        if is_change:
            stock[sku] = min(INT_MAX, max(0, s + v))
        else:
            ok = s >= v
            stock[sku] = s - v if ok else s
            exp[f"o{i}"] = (ok, stock[sku])
    assert got == exp
