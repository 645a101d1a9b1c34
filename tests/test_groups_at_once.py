"""Processors that take all keys of a group at once, against one key after the other."""
import datetime as dt
import random
from collections import Counter, namedtuple
from types import SimpleNamespace

import pandas as pd
import pytest

from emporia.streaming import grouped as G
from emporia.streaming import processors as P

T0 = dt.datetime(2024, 1, 1)
MIN = dt.timedelta(minutes=1)


def group(processor, ddl, batches, watermarks=None):
    """(outputs, what is kept) of a group over micro-batches, through its arrays."""
    fields = G.T.StructType([G.T.StructField(n, t) for n, t in (x.split() for x in ddl.split(", ")) for t in [
        {"string": G.T.StringType(), "long": G.T.LongType(), "int": G.T.IntegerType(), "boolean": G.T.BooleanType(), "timestamp_ntz": G.T.TimestampNTZType()}[t]]]).fields
    h, row = G._Handle(SCHEMAS), namedtuple("row", [f.name for f in fields])
    processor.init(h)
    kept, outs = [[] for _ in G.state_schema(h, G.T.StringType()).fields], []
    for i, batch in enumerate(batches):
        if not batch:      # Spark calls with rows only
            outs.append(Counter())
            continue
        data = {}
        for j, f in enumerate(fields):
            v = [r[j] for r in batch]
            data[f.name] = v if isinstance(f.dataType, G.T.StringType) else [0 if x is None else G._micros(x) if isinstance(x, dt.datetime) else int(x) for x in v]
        nulls = [sum((r[j] is None) << j for j, f in enumerate(fields) if not isinstance(f.dataType, G.T.StringType)) for r in batch]
        if watermarks:
            kept = processor.stillKept(kept, G._micros(watermarks[i]) // 1000)
        columns, kept, rest = processor.handleGroup(G.Rows(pd.DataFrame({**data, "_nulls": nulls}), fields), kept)
        out = [tuple(x.item() if hasattr(x, "dtype") and x.dtype.kind in "Mi" else x for x in r) for r in zip(*columns)]
        if rest is not None:
            mine, more = {}, {}
            for r in map(row._make, zip(*G._decoded(rest.pdf, fields))):
                mine.setdefault(r[0], []).append(r)
            for k, of in mine.items():
                h.load({})
                out += [tuple(r) for r in processor.handleInputRows((k,), iter(of), None)]
                if set(left := h.save()) - {None}:
                    more[k] = left
            kept = G._joined(kept, G._pack(more, h), h)
        outs.append(Counter(out))
        kept = G._of_batch(G._to_batch(kept, G.to_arrow_schema(G.state_schema(h, G.T.StringType()))))
    return outs, G._unpack(tuple(kept), h)


def alone(processor, ddl, batches):
    row = namedtuple("row", [x.split()[0] for x in ddl.split(", ")])
    h, kept, outs = G._Handle(SCHEMAS), {}, []
    processor.init(h)
    for batch in batches:
        mine, out = {}, []
        for r in batch:
            mine.setdefault(r[0], []).append(row(*r))
        for k, of in mine.items():
            h.load(kept.pop(k, {}))
            out += [tuple(r) for r in processor.handleInputRows((k,), iter(of), None)]
            kept[k] = h.save()
        outs.append(Counter(out))
    return outs, kept


_types = {"boolean": G.T.BooleanType(), "long": G.T.LongType(), "int": G.T.IntegerType(), "string": G.T.StringType(), "timestamp_ntz": G.T.TimestampNTZType()}
SCHEMAS = {d: [G.T.StructField(n, _types[t]) for n, t in (x.split() for x in d.split(", "))] for d in (
    "end timestamp_ntz, total long, received long, failed boolean", "l_linenumber int, l_partkey long, l_suppkey long, qty int, sku string, success boolean",
    "at timestamp_ntz", "status string", "seen boolean")}
GATHER = ("order_number string, at timestamp_ntz, side int, total_items long, l_linenumber int, l_partkey long, l_suppkey long, qty int, sku string, "
          "success boolean, reason string")
ORDERS = "order_number string, at timestamp_ntz, kind string, rank int, known boolean, payment_id string"
KEYS = ["a", "b", "c", "d", "e", None]


def in_batches(rows, n=3):
    rows = sorted(rows, key=lambda r: r[1])
    cut = [T0 + dt.timedelta(hours=2) * i / n for i in range(n + 1)]
    return [[r for r in rows if a <= r[1] < b] for a, b in zip(cut, cut[1:])], cut


@pytest.mark.parametrize("seed", range(60))
def test_gather_of_a_group_equals_its_keys_alone(seed):
    r, rows = random.Random(seed), []
    for _ in range(r.choice([1, 8, 40, 250])):
        k, at = r.choice(KEYS[:r.choice([1, 6])]), T0 + r.randrange(7200) * dt.timedelta(seconds=1)
        if r.random() < r.choice([0.1, 0.4]):
            total = r.choice([0, 1, 2, 3, None])
            rows.append((k, at, 0, total, None, None, None, None, None, None, None))
        else:
            line, ok = r.randint(1, 3), r.choice([True, True, True, False, None])
            one = (1, line, line, 1, line, r.choice(["S", None]), ok, None if ok else "no")
            rows += [(k, at, one[0], None, *one[1:])] * r.choice([1, 1, 2])
    batches, cut = in_batches(list(dict.fromkeys((x[0], x[1], x[2]) + x[3:] for x in rows)) + [x for x in rows if x[2] and r.random() < .3])
    got, left = group(P.Gather(), GATHER, batches, cut)
    want, kept = alone(P.Gather(), GATHER, batches)
    # of two placements at one instant the first to come counts, of two results their order is told by the rest
    assert got == want
    live = lambda k: {a: {n: x for n, x in v.items() if n} for a, v in k.items() if "saga" in v and v["saga"][0] >= cut[-2]}
    assert live(left) == live(kept) and all(len(v[None]) >= 1 for v in left.values())


@pytest.mark.parametrize("processor", [P.StatusMachine, P.PaymentGate])
@pytest.mark.parametrize("seed", range(25))
def test_orders_of_a_group_equal_orders_alone(processor, seed):
    r, rows = random.Random(seed), []
    for i in range(r.choice([1, 30, 300])):
        rank = r.choice([P.PAYMENT, P.LINE, P.PLACED, P.EVENT, P.EVENT])
        kind = {P.PAYMENT: "PAYMENT", P.LINE: "LINE", P.PLACED: "PLACED"}.get(rank) or r.choice(["VALIDATED", "FAILED", "PAID", "PAY_FAILED", "OTHER"])
        rows.append((r.choice(KEYS), T0 + r.randrange(24) * 5 * MIN, kind, rank, r.choice([True, False, None]), f"p{i}" if rank == P.PAYMENT else None))
    batches, _ = in_batches(rows)
    got, left = group(processor(), ORDERS, batches)
    want, kept = alone(processor(), ORDERS, batches)
    assert got == want and left == {k: v for k, v in kept.items() if v}


def test_an_order_without_a_time_is_not_placed():
    rows = [("a", None, "PLACED", P.PLACED, None, None), ("a", None, "PAID", P.EVENT, None, None)]
    assert group(P.StatusMachine(), ORDERS, [rows]) == alone(P.StatusMachine(), ORDERS, [rows])[:1] + ({},)


def test_events_without_a_time_are_told_and_kept_in_no_record():
    rows = [("a", None, 0, 1) + (None,) * 7, ("a", None, 1, None, 2, 1, 1, 1, "S", False, "second"), ("a", None, 1, None, 1, 1, 1, 1, "S", False, "first"),
            ("b", T0, 0, 1) + (None,) * 7, ("b", None, 1, None, 1, 1, 1, 1, "S", True, None)]
    out, left = group(P.Gather(), GATHER, [rows])
    assert out == [Counter([("a", "PENDING", None, None), ("a", "FAILED", "first", None), ("b", "PENDING", None, T0)])] and list(left) == ["b"]


@pytest.mark.parametrize("seed", range(8))
def test_first_events_of_a_group_equal_those_of_its_keys(seed):
    r, ddl = random.Random(seed), "order_number string, ts timestamp_ntz, attempt int, user_id long"
    rows = [(r.choice(KEYS), T0 + r.randrange(24) * 5 * MIN, r.randint(0, 2), r.choice([None, 7])) for _ in range(40)]
    rows = list({x[:3]: x for x in rows}.values())
    batches, _ = in_batches(rows)
    batches[0] += [("x", None, 1, 3), ("x", None, 2, 4)]
    got, left = group(P.FirstWins(), ddl, batches)
    want, kept = alone(P.FirstWins(), ddl, batches)
    assert got == want and left == kept


def test_a_hot_order_is_gathered_without_a_step_per_row():
    n = 200_000
    rows = [("hot", T0, 0, n) + (None,) * 7] + [("hot", T0, 1, None, i, i, 1, 1, "S", True, None) for i in range(n)]
    calls, processor = [], P.Gather()
    processor.handleInputRows = lambda *a: calls.append(a)
    out, left = group(processor, GATHER, [rows])
    assert out[0][("hot", "VALIDATED", None, T0)] == 1 and not left and not calls
