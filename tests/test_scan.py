"""Skew-safe scans against a brute-force fold (hot key, tiny batches, many partitions)."""
import random
from collections import defaultdict

from emporia.functions.scalars import INT_MAX
from emporia.plans.scan import clamped_final, clamped_running


def _rows(seed, n=1500, hot=0.45):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = "HOT" if rnd.random() < hot else f"k{rnd.randint(0, 25)}"
        c = rnd.randint(-120, 100) if rnd.random() < 0.95 else rnd.choice([INT_MAX, -INT_MAX, 2 * INT_MAX])
        out.append((k, i, c))
    return out


def _brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    running, clamped = {}, {}
    for rs in by.values():
        rs.sort(key=lambda r: r[1])
        s, v, prev = 0, 0, None
        for n, (_, seq, c) in enumerate(rs, 1):
            s += c
            v = min(INT_MAX, max(0, v + c))
            running[seq] = (n, s, prev)
            clamped[seq] = v
            prev = seq
    return running, clamped


def test_clamped_running_matches_brute_force_both_bounds(spark):
    rows = _rows(11)
    df = spark.createDataFrame(rows, "k string, seq long, c long")
    got = {r.seq: r.v for r in clamped_running(df, ["k"], ["seq"], "c", 0, INT_MAX, out_col="v",
                                               partitions=5).collect()}
    assert got == _brute(rows)[1]


def test_aqe_sized_range_partitions(spark):
    rows = _rows(3, n=3000)
    df = spark.createDataFrame(rows, "k string, seq long, c long")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "2k")
    try:
        got_c = {r.seq: r.v for r in clamped_running(df, ["k"], ["seq"], "c", 0, INT_MAX, out_col="v").collect()}
    finally:
        spark.conf.set(key, old)
    assert got_c == _brute(rows)[1]


def test_results_do_not_depend_on_exchange_reuse(spark):
    rows = _rows(5, n=2500)
    df = spark.createDataFrame(rows, "k string, seq long, c long")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        final = {r.k: (r.v, r.n) for r in clamped_final(df, ["k"], ["seq"], "c", 0, INT_MAX, out_col="v",
                                                        partitions=6).collect()}
        run_c = {r.seq: r.v for r in clamped_running(df, ["k"], ["seq"], "c", 0, INT_MAX, out_col="v",
                                                     partitions=6).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    _, clamped = _brute(rows)
    assert run_c == clamped
    last = {}
    for k, seq, _ in sorted(rows, key=lambda r: r[1]):
        last[k] = (clamped[seq], last.get(k, (0, 0))[1] + 1)
    assert final == last


def test_rows_without_a_key_are_a_key_of_their_own(spark):
    rows = [(None, i, 5) for i in range(40)] + [("a", i, -1) for i in range(40, 50)]
    df = spark.createDataFrame(rows, "k string, seq long, c long")
    got = {r.seq: r.v for r in clamped_running(df, ["k"], ["seq"], "c", 0, INT_MAX, out_col="v", partitions=5).collect()}
    assert got == {i: 5 * (i + 1) if i < 40 else 0 for i in range(50)}
