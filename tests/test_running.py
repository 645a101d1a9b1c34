"""Running values against a plain loop; hot keys in pieces."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from emporia.plans.running import piece_bounds, running
from emporia.plans.skew import heavy_keys

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, i long, c long, x string"


def rows_of(seed, n=1200):
    r = random.Random(seed)
    return [(r.choice(["HOT", "HOT", "a", "b", None]), T0 + dt.timedelta(minutes=r.randrange(n // 3)), i, r.randint(-5, 9),
             r.choice([None, None, "p", "q", "r"])) for i in range(n)]


def brute(rows):
    out, s, last = {}, {}, {}
    for k, ts, i, c, x in sorted(rows, key=lambda r: (r[1], r[2])):
        s[k] = s.get(k, 0) + c
        out[i] = (s[k], last.get(k))
        last[k] = x if x is not None else last.get(k)
    return out


@pytest.mark.parametrize("heavy", [None, {}, {"HOT": 7}, {"HOT": 40, "b": 3}, {"nobody": 4}])
def test_running_equals_a_loop(spark, heavy):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = running(df, "k", ["ts", "i"], sums={"s": F.col("c")}, lasts={"last": F.col("x")}, heavy=heavy)
    assert got.columns == [*df.columns, "s", "last"]
    assert {r.i: (r.s, r["last"]) for r in got.collect()} == brute(rows)


def test_a_hot_key_is_cut_into_even_pieces(spark):
    df = spark.createDataFrame(rows_of(4, 4000), SCHEMA)
    heavy = heavy_keys(df, "k", 20)
    assert heavy["HOT"] >= 8
    bounds = piece_bounds(df, "k", ["ts", "i"], heavy)["HOT"]
    assert len(bounds) == heavy["HOT"] - 1 and bounds == sorted(bounds)
    size = [0] * (len(bounds) + 1)
    for r in df.where("k = 'HOT'").collect():
        size[sum(b <= (r.ts, r.i) for b in bounds)] += 1
    assert max(size) < 0.3 * sum(size)
    plan = running(df, "k", ["ts", "i"], sums={"s": F.col("c")}, heavy=heavy)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\w+, _piece#", plan) and "Python" not in plan


def test_empty(spark):
    assert running(spark.createDataFrame([], SCHEMA), "k", ["ts"], sums={"s": F.col("c")}).count() == 0
