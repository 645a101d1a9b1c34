"""Joins with a side that has few rows per key, safe against hot keys.

A hash join sends all rows of a key to one task. Adaptive execution splits
such a partition only where the join reads plain exchanges, which it does not
when a side has just been aggregated by the same key. Here heavy keys are
found first (one pass over the key column with a fixed-size sketch, no
shuffle), their rows are dealt over as many salts as their share of the rows
is worth, and their few rows of the other side are repeated once per salt.
Other keys have one salt. Which keys count as heavy decides speed only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_partitions

TRACKED = 10_000     # keys that the sketch tracks
HEAVY = 4            # times the mean rows of a partition


def heavy_keys(rows: DataFrame, key: str, partitions: int | None = None, limit: int = 100) -> dict[str, int]:
    """{key: salts} of the keys with several times the rows of a mean
    partition; at most ``limit`` of them."""
    parts = partitions or default_partitions(rows.sparkSession)
    got = rows.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {limit}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    least = max(1, HEAVY * got.n / parts) if parts > HEAVY else got.n / 2
    return {t["item"]: min(parts, math.ceil(t["count"] * parts / got.n)) for t in got.top or [] if t["count"] >= least}


def split_join(rows: DataFrame, one: DataFrame, key: str, heavy: dict[str, int], how: str = "left",
               spread: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """``rows`` joined with ``one`` on ``key`` (and ``condition``); the rows of
    a heavy key are dealt by the columns in ``spread`` (all of them if none are given)."""
    if not heavy:
        on = rows[key] == one[key]
        return rows.join(one, on if condition is None else on & condition, how).drop(one[key])
    salts = F.create_map(*[F.lit(x) for item in heavy.items() for x in item])
    dealt = F.coalesce(F.pmod(F.xxhash64(*(spread or rows.columns)), salts[F.col(key)]), F.lit(0).cast("bigint"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(salts[F.col(key)], F.lit(1)).cast("bigint") - 1)
    left = rows.withColumn("_salt", dealt)
    right = one.withColumn("_copy", F.explode(copies))
    on = (left[key] == right[key]) & (left["_salt"] == right["_copy"])
    return left.join(right, on if condition is None else on & condition, how).drop(right[key]).drop("_salt", "_copy")


def validity(versions: DataFrame, key: str, since: str, order: list[str]) -> DataFrame:
    """``versions`` with ``_since`` and ``_until``: a version holds from its time
    to that of the next one of its key (of versions at one time the last)."""
    w = Window.partitionBy(key).orderBy(since, *order)
    return versions.withColumn("_since", F.col(since)).withColumn("_until", F.lead(since).over(w))


def asof_join(rows: DataFrame, versions: DataFrame, key: str, at: str, heavy: dict[str, int], how: str = "left",
              spread: list[str] | None = None) -> DataFrame:
    """Each row with the version of its key that holds at the row's time; at
    most one, as validities do not overlap. ``versions`` comes from
    :func:`validity`."""
    holds = (F.col("_since") <= rows[at]) & (F.col("_until").isNull() | (rows[at] < F.col("_until")))
    return split_join(rows, versions, key, heavy, how, spread, holds).drop("_since", "_until")
