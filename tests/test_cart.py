"""Carts against a plain simulation: expiry, refusal, snapshots, checkout."""
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emporia.operators import cart as C

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
EV = "user_id long, ts timestamp_ntz, event_id long, kind string, sku string, qty int"
FEED = "seq long, ts timestamp_ntz, sku string, name string, price string, image_url string"


def events(spark, rows):
    return spark.createDataFrame(rows, EV)


def feed(spark, rows):
    return spark.createDataFrame(rows, FEED).withColumn("price", F.col("price").cast("decimal(18,2)"))


def simulate(ev, versions, now):
    """(checkouts, live carts at ``now``, sessions), event by event."""
    carts, sent, sessions = {}, {}, []      # user -> [start, last add, adds, qty, {sku: [qty, snapshot]}]

    def end(u, when, checked):
        start, last, n, q, _ = carts.pop(u)
        sessions.append((u, start, when, checked, n, q))

    for u, ts, i, kind, sku, qty in sorted(ev, key=lambda e: (e[1], e[2])):
        if u in carts and ts > carts[u][1] + 24 * HOUR:
            end(u, carts[u][1] + 24 * HOUR, False)
        if kind == "add":
            held = [v for v in versions if v[2] == sku and v[1] <= ts]
            if not held:
                continue
            snap = max(held, key=lambda v: (v[1], v[0]))[3:]
            cart = carts.setdefault(u, [ts, ts, 0, 0, {}])
            cart[1:4] = [ts, cart[2] + 1, cart[3] + qty]
            line = cart[4].setdefault(sku, [0, None])
            line[0] += qty
            line[1] = snap
        elif kind == "remove" and u in carts:
            carts[u][4].pop(sku, None)
        elif kind == "checkout" and u in carts:
            if carts[u][4]:
                sent[(u, i)] = sorted((s, q, Decimal(snap[1])) for s, (q, snap) in carts[u][4].items())
            end(u, ts, True)
    live = {(u, s): (q, *snap) for u, c in carts.items() if c[1] + 24 * HOUR >= now for s, (q, snap) in c[4].items()}
    for u in list(carts):
        end(u, carts[u][1] + 24 * HOUR, False)
    return sent, live, sessions


def case(seed, n=700):
    r = random.Random(seed)
    ev, clock = [], {}
    for i in range(n):
        u = 1 if r.random() < 0.4 else r.randrange(2, 9)      # a hot user
        clock[u] = clock.get(u, T0) + r.choice([0 * HOUR, HOUR, 5 * HOUR, 24 * HOUR, 24 * HOUR, 25 * HOUR])
        ev.append((u, clock[u], i, r.choice(["add"] * 5 + ["remove", "checkout"]), f"S{r.randrange(4)}", r.randint(1, 3)))
    last = max(clock.values())
    versions = [(v, T0 + (last - T0) * (v - 1) / 4 + (last - T0) * (s == 3) / 3, f"S{s}", f"n{s}.{v}", f"{s + 1}.{v}0", None if v == 2 else f"i{v}")
                for s in range(4) for v in (1, 2, 3)]
    return ev, versions, last


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("heavy", [{}, {1: 6}])
def test_carts_equal_simulation(spark, seed, heavy, monkeypatch):
    monkeypatch.setattr(C, "heavy_keys", lambda df, key: heavy if key == "user_id" else {"S1": 3} if heavy else {})
    ev, versions, now = case(seed)
    sent, live, sessions = simulate(ev, versions, now)
    e, f = events(spark, ev).repartition(4), feed(spark, versions)
    got = {(r.user_id, r.checkout_id): [(x.sku, x.qty, x.price) for x in r["items"]] for r in C.cart_checkout(e, f).collect()}
    assert got == sent and len(sent) > 20
    rows = {(r.user_id, r.sku): (r.qty, r["name"], str(r.price), r.image_url) for r in C.cart_replay(e, f).collect()}
    assert rows == live
    fmt = "%Y-%m-%d %H:%M:%S"
    got = sorted((r.user_id, r.session_start, r.session_end, r.checked_out, r.n_adds, r.qty) for r in C.cart_sessions(e, f).collect())
    assert got == sorted((u, a.strftime(fmt), b.strftime(fmt), c, n, q) for u, a, b, c, n, q in sessions)


ONE = [(1, T0 - HOUR, "A", "a1", "1.50", None), (2, T0 + 2 * HOUR, "A", "a2", "2.00", "i"), (1, T0 + 50 * HOUR, "B", "b", "9.00", None)]


def test_a_gap_of_exactly_24h_goes_on(spark):
    ev = events(spark, [(1, T0, 1, "add", "A", 1), (1, T0 + 24 * HOUR, 2, "add", "A", 1),
                        (1, T0 + 48 * HOUR + dt.timedelta(microseconds=1), 3, "add", "A", 1)])
    got = sorted((r.session_start, r.n_adds) for r in C.cart_sessions(ev, feed(spark, ONE)).collect())
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-03 00:00:00", 1)]


def test_an_expired_cart_is_empty_for_replay_and_checkout(spark):
    ev = events(spark, [(1, T0, 1, "add", "A", 2), (1, T0 + 25 * HOUR, 2, "checkout", None, 1), (2, T0, 3, "add", "A", 1)])
    assert C.cart_checkout(ev, feed(spark, ONE)).count() == 0
    assert C.cart_replay(ev, feed(spark, ONE)).count() == 0
    got = C.cart_replay(ev, feed(spark, ONE), as_of=T0 + 24 * HOUR).collect()
    assert {(r.user_id, r.qty) for r in got} == {(1, 2), (2, 1)}


def test_the_snapshot_is_of_the_last_add_and_unknown_products_are_refused(spark):
    ev = events(spark, [(1, T0, 1, "add", "A", 2), (1, T0 + 3 * HOUR, 2, "add", "A", 1), (1, T0 + 4 * HOUR, 3, "add", "B", 7),
                        (2, T0, 4, "add", "A", 1), (2, T0 + 5 * HOUR, 5, "remove", "A", 1)])
    got = [(r.user_id, r.sku, r.qty, r.product_name, str(r.price), r.image_url)
           for r in C.cart_view(C.cart_replay(ev, feed(spark, ONE))).collect()]
    assert got == [(1, "A", 3, "a2", "2.00", "i")]


def test_a_line_without_name_and_price_gets_the_defaults(spark):
    ev = events(spark, [(1, T0, 1, "add", "A", 2)])
    got = C.cart_view(C.cart_replay(ev, feed(spark, [(1, T0, "A", None, None, None)]))).first()
    assert (got.product_name, str(got.price), got.image_url) == ("Sản phẩm không rõ", "0.00", None)


def test_checkout_empties_and_remove_deletes_the_line(spark):
    ev = events(spark, [(1, T0, 1, "add", "A", 2), (1, T0 + HOUR, 2, "add", "A", 1), (1, T0 + 2 * HOUR, 3, "remove", "A", 1),
                        (1, T0 + 3 * HOUR, 4, "add", "A", 5), (1, T0 + 4 * HOUR, 5, "checkout", None, 1), (1, T0 + 5 * HOUR, 6, "add", "A", 3),
                        (2, T0, 7, "checkout", None, 1)])
    assert [(r.user_id, r.sku, r.qty) for r in C.cart_replay(ev, feed(spark, ONE)).collect()] == [(1, "A", 3)]
    ck = C.cart_checkout(ev, feed(spark, ONE)).collect()      # user 2's cart is empty: no event (B6)
    assert [(r.user_id, r.checkout_id, [(i.sku, i.qty) for i in r["items"]]) for r in ck] == [(1, 5, [("A", 5)])]
