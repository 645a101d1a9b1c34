"""Keys run in groups, replays kept, unsaved orders from priced lines."""
import datetime as dt

import pytest

from emporia.operators import orders as O
from emporia.operators import flow as W
from emporia.session import scratch_path
from emporia.sources import sinks as SK
from emporia.streaming import grouped as G
from emporia.streaming import jobs as J
from emporia.streaming import processors as P
from emporia.streaming.harness import Staged, drain

T0 = dt.datetime(2024, 1, 1)


def test_a_group_has_the_results_of_its_keys(spark):
    """Many keys in one group over several batches, as one key after the other would have it."""
    rows = [(f"o{i % 7}" if i % 11 else None, T0 + dt.timedelta(hours=i), i) for i in range(60)]
    placed = spark.createDataFrame(rows, "order_number string, ts timestamp_ntz, attempt int")
    out = ", ".join(f"{n} {t}" for n, t in placed.dtypes)
    got = drain(Staged(placed, "g", slices=3), lambda s: G.per_key(s, "order_number", P.FirstWins(), out, groups=1), "g").drop("batch_id")
    want = {}
    for r in rows:
        want.setdefault(r[0], r)
    assert {tuple(r) for r in got.collect()} == set(want.values()) and got.count() == len(want)


def test_stream_state_is_kept_per_group_of_keys(spark):
    h = G._Handle({})
    P.Gather().init(h)
    names = G.state_schema(h, G.T.StringType()).names
    assert names[0] == "keys" and {"saga_at", "saga_end", "seen_qty", "timer_ms"} <= set(names)


def test_what_a_group_keeps_comes_back(spark):
    h = G._Handle({})
    h.values, h.maps = {"v": G.T.StructType().add("end", "timestamp_ntz").add("n", "long").fields}, \
        {"m": (G.T.StructType().add("k", "integer").fields, G.T.StructType().add("at", "timestamp_ntz").fields)}
    kept = {"a": {"v": (T0, None)}, None: {"m": {(1,): (T0,), (2,): (None,)}}, "c": {"v": (None, 2), None: {5, 9}}}
    assert G._unpack(G._pack(kept, h), h) == kept


def test_known_lines_are_not_sent_to_the_status_machine(spark):
    rows = [("a", "LINE", P.LINE, True), ("a", "LINE", P.LINE, False), ("a", "PLACED", P.PLACED, None)]
    df = spark.createDataFrame([(*r, T0) for r in rows], "order_number string, kind string, rank int, known boolean, ts timestamp_ntz")
    assert sorted(r.known is None for r in J._decisive(df).collect()) == [False, True]


def test_unsaved_orders_from_priced_lines(spark):
    lines = spark.createDataFrame([("1", "A", 1, T0), ("2", "A", 1, T0 - dt.timedelta(9)), ("3", "X", 1, T0), ("4", "A", 1, None), ("5", "X", 1, None), ("6", None, 1, T0)],
                                  "order_number string, sku string, qty int, ts timestamp_ntz").withColumn("l_linenumber", G.F.lit(1))
    feed = spark.createDataFrame([(1, T0 - dt.timedelta(3), "A", "n", None, "c", "s"), (2, T0 - dt.timedelta(1), "A", "n", None, "c", "s")],
                                 "seq long, ts timestamp_ntz, sku string, name string, price decimal(18,2), color string, size string")
    got = O.unsaved_from(O.price_lines(lines, feed), lines, feed)
    want = {r.order_number for r in O.unsaved_orders(lines, feed).collect()}
    assert {r.order_number for r in got.collect()} == want == {"2", "3", "5", "6"}


def test_a_sku_has_the_results_of_its_last_replay(spark):
    res = lambda *r: spark.createDataFrame([(s, n) for s, n in r], "sku string, n int")
    sku = lambda *s: spark.createDataFrame([(x,) for x in s], "sku string")
    got = W._last_replays(res(("A", 0), ("B", 0), ("C", 0), (None, 0)), [(sku("A", "B"), res(("A", 1), ("B", 1))), (sku("B"), res(("B", 2)))])
    assert sorted(map(tuple, got.collect()), key=str) == [("A", 1), ("B", 2), ("C", 0), (None, 0)]


def test_the_keyed_sink_samples_no_bounds(spark):
    jobs, path = spark.sparkContext.statusTracker(), scratch_path(spark, "t-sink")
    spark.sparkContext.setJobGroup("sink", "sink")
    SK.write_keyed(spark.range(500).selectExpr("'HOT' sku", "id"), "sku", path, buckets=8)
    ids = jobs.getJobIdsForGroup("sink")
    spark.sparkContext.setJobGroup("", "")
    assert SK.read_keyed(spark, path).count() == 500 and len(ids) <= 2


@pytest.mark.parametrize("mode", ["stock", "reserve"])
def test_keys_walked_together_equal_keys_walked_alone(mode):
    import random
    from types import SimpleNamespace
    import pandas as pd
    from test_streaming import run
    r = random.Random(3)
    cols = ["sku", "ts", "kind", "l_orderkey", "l_linenumber", "l_suppkey", "amount", "chg", "order_number"]
    data = [(r.choice("ABC"), i, r.randint(0, 1), i, 1, 1, r.randint(0, 9), r.randint(-9, 12), f"o{i}") for i in range(200)]
    kinds = {"sku": "string", "order_number": "string", "ts": "timestamp_ntz"}
    fields = [G.T.StructField(c, {"string": G.T.StringType(), "timestamp_ntz": G.T.TimestampNTZType()}.get(kinds.get(c), G.T.LongType())) for c in cols]
    kept, got = {}, []
    proc = P.StockFold if mode == "stock" else P.ReserveFold
    for part in (data[:90], data[90:]):
        got.append(proc().handleKeys(G.Rows(pd.DataFrame(part, columns=cols).assign(_nulls=0).sample(frac=1, random_state=1), fields), kept))
    left = {}
    for k in "ABC":
        mine = [[SimpleNamespace(**dict(zip(cols, d))) for d in part if d[0] == k] for part in (data[:90], data[90:])]
        out, h = run(proc(), *mine)
        left[k] = {"stock": h.states["stock"].v}
        if mode == "reserve":
            assert [(x.order_number, x.success, x.stock_after) for b in out for x in b] == \
                [(o, bool(s), a) for g in got for o, sku, s, a in zip(g[0], g[1], g[7], g[9]) if sku == k]
    assert kept == left
