"""Running sums and last values per key, in order, with hot keys in pieces.

A window over a key puts all its rows into one task. Here only keys of
ordinary size are left whole. A heavy key (``skew.heavy_keys``) is cut into
pieces by bounds on the order, taken from a bounded sample of its rows and
written into the plan as literals: which piece a row is in follows from the
row alone, so every evaluation agrees and nothing needs a checkpoint. A window
over (key, piece) gives the local values; what the earlier pieces of a key add
is one row per piece of a heavy key (at most 100 keys of ``PIECES`` pieces),
which is why it may be broadcast. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import heavy_keys

PIECES = 256      # of a heavy key, at most
SAMPLED = 20      # rows of a heavy key that are looked at per piece


def piece_bounds(df: DataFrame, key: str, order: list[str], heavy: dict[str, int]) -> dict:
    """{heavy key: order tuples that begin its second and later pieces}."""
    if not heavy:
        return {}
    pieces = {k: min(n, PIECES) for k, n in heavy.items()}
    known = df.where(F.col(key).isin(*heavy)).dropna(subset=order).select(key, *order)
    h = F.xxhash64(*order)
    share = F.pmod(h, F.lit(SAMPLED * max(pieces.values())))
    seen: dict = {}
    for r in known.groupBy(key, share.alias("_s")).agg(F.min_by(F.struct(*order), h).alias("o")).collect():
        seen.setdefault(r[key], []).append(tuple(r.o))
    out = {}
    for k, rows in seen.items():
        rows.sort()
        n = min(pieces[k], len(rows))
        out[k] = sorted({rows[i * len(rows) // n] for i in range(1, n)})
    return out


def _piece(df: DataFrame, key: str, order: list[str], bounds: dict) -> Column:
    at = F.struct(*order)
    tuple_of = lambda b: F.struct(*[F.lit(str(v)).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, b)])
    out = F.lit(0)
    for k, rows in bounds.items():
        if rows:
            begun = F.size(F.filter(F.array(*[tuple_of(b) for b in rows]), lambda b: b <= at))
            out = F.when(F.col(key) == F.lit(k), begun).otherwise(out)
    return out


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, heavy: dict | None = None) -> DataFrame:
    """``df`` with, per key and in ``order``, running sums (including the row)
    and last values that are not null (before the row)."""
    sums, lasts = sums or {}, lasts or {}
    heavy = heavy_keys(df, key) if heavy is None else heavy
    bounds = piece_bounds(df, key, order, heavy)
    given = df.select("*", _piece(df, key, order, bounds).alias("_piece"),
                      *[c.alias(f"_s_{n}") for n, c in sums.items()], *[c.alias(f"_l_{n}") for n, c in lasts.items()])
    w = Window.partitionBy(key, "_piece").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = given.select("*", *[F.sum(f"_s_{n}").over(upto).alias(n) for n in sums],
                         *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(n) for n in lasts])
    if bounds:
        at = F.struct(*order)
        per = given.where(F.col(key).isin(*bounds)).groupBy(key, "_piece").agg(
            *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
            *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), at)).alias(f"_l_{n}") for n in lasts],
            F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        carry = per.select(F.col(key).alias("_k"), F.col("_piece").alias("_p"),
                           *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
                           *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts])
        local = local.join(F.broadcast(carry), (F.col(key) == F.col("_k")) & (F.col("_piece") == F.col("_p")), "left")
    held = lambda n: F.col(f"_c_{n}") if bounds else F.lit(None)
    return local.select(*df.columns, *[(F.col(n) + F.coalesce(held(n), F.lit(0))).alias(n) if bounds else F.col(n) for n in sums],
                        *[F.coalesce(F.col(n), held(n)).alias(n) if bounds else F.col(n) for n in lasts])
