"""Clamped folds per key, skew-safe.

Spark windows ``partitionBy(key).orderBy(seq)`` put every row of a key in one
task, so one hot key (say a third of all rows) becomes one straggler, and a
fold with two clamps is no window function anyway. Here it runs over a *range*
partitioning of ``(key, seq)``: the range partitioner samples the data, so a
hot key is split into contiguous pieces across many tasks. Each task composes
the steps of the runs (maximal blocks of one key) it holds, in one vectorised
pass over Arrow batches with constant memory. Only keys that cross a partition
boundary need a carry from earlier partitions; at most two runs per partition
can do so, so the carry table has at most ``2 x partitions`` rows. That bound
is what lets us broadcast it. Running sums and last values, which are window
functions, are in ``plans.running``.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None) -> DataFrame:
    """Range partitioning by (keys, order), sorted inside each partition.

    Without an explicit count the exchange starts at
    ``spark.sql.shuffle.partitions`` and AQE may coalesce neighbouring range
    partitions by measured size; coalescing keeps the range order, and the
    carry bound (two edge rows per partition) only gets smaller.
    """
    ranged = (df.repartitionByRange(partitions, *keys, *order) if partitions
              else df.repartitionByRange(*keys, *order))
    return ranged.sortWithinPartitions(*keys, *order)


# ---------------------------------------------------------------------------
# Clamped fold  s <- min(hi, max(lo, s + c))  per key, skew-safe.
#
# A run of clamp steps composes to x -> min(H, max(L, x + S)) where S is the
# sum of the changes, L = f(-inf) and H = f(+inf). So each row gets the exact
# composed function of its run prefix inside the partition, and a key crossing
# partitions is stitched by folding the (S, L, H) of its earlier runs.
# ---------------------------------------------------------------------------

def _runs(pdf: pd.DataFrame, keys: Sequence[str], prev_key) -> np.ndarray:
    """Boolean array: row starts a new run (key differs from the row before)."""
    n = len(pdf)
    new = np.zeros(n, dtype=bool)
    for k in keys:
        arr = pdf[k].to_numpy()
        if n > 1:
            new[1:] |= arr[1:] != arr[:-1]
    new[0] = True if prev_key is None else any(pdf[k].iat[0] != pv for k, pv in zip(keys, prev_key))
    return new


def _clamp_batch(c: np.ndarray, g: np.ndarray, carry, lo: int, hi: int):
    """Exact prefix (S, L, H) per row of one Arrow batch; ``g`` numbers the
    run segments, 0 = the run continued from the previous batch (``carry``).

    Vectorised closed forms of one-sided reflection (grouped cumsum / cummin /
    cummax, int64); a batch where a run would cross one bound after touching
    the other falls back to the plain loop (it takes a stock near 2^31).
    """
    cs = pd.Series(c).groupby(g).cumsum().to_numpy()
    cmin = pd.Series(cs).groupby(g).cummin().to_numpy()
    cmax = pd.Series(cs).groupby(g).cummax().to_numpy()
    s0, l0, h0 = carry
    cont = g == 0
    L = lo + cs - cmin
    H = hi + cs - cmax
    S = cs.copy()
    if cont.any():
        L[cont] = np.maximum(l0 + cs[cont], L[cont])
        H[cont] = np.minimum(h0 + cs[cont], H[cont])
        S[cont] += s0
    if (L <= hi).all() and (H >= lo).all():
        return S, L, H
    L = np.empty(len(c), dtype="int64")
    H = np.empty(len(c), dtype="int64")
    lv = hv = None
    for i in range(len(c)):
        if i == 0 or g[i] != g[i - 1]:
            lv, hv = (l0, h0) if g[i] == 0 else (None, None)
        x = int(c[i])
        lv = lo if lv is None else min(hi, max(lo, lv + x))
        hv = hi if hv is None else min(hi, max(lo, hv + x))
        L[i], H[i] = lv, hv
    return S, L, H


def _clamp_kernel(keys: Sequence[str], col: str, lo: int, hi: int, summary: bool):
    """Per-row (S, L, H) of the run prefix, or (``summary``) one row per run
    with its totals and row count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx is not None else 0
        prev_key = None
        carry = (0, lo, hi)
        carry_n = 0
        runs_seen = 0
        pending = None            # rows held back until we know whether their run ends
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            new = _runs(pdf, keys, prev_key)
            g = np.cumsum(new)
            S, L, H = _clamp_batch(pdf[col].to_numpy(dtype="int64"), g, carry, lo, hi)
            if summary:
                cnt = pd.Series(np.ones(n, dtype="int64")).groupby(g).cumsum().to_numpy()
                cnt[g == 0] += carry_n
                if pending is not None and new[0]:
                    yield pending
                end = np.zeros(n, dtype=bool)
                end[:-1] = new[1:]
                closed = pdf.loc[end, list(keys)].assign(_part=part, _S=S[end], _L=L[end], _H=H[end],
                                                         _n=cnt[end])
                if len(closed):
                    yield closed
                pending = pdf.iloc[[n - 1]][list(keys)].assign(_part=part, _S=S[-1:], _L=L[-1:], _H=H[-1:],
                                                              _n=cnt[-1:])
                carry_n = int(cnt[-1])
            else:
                out = pdf.copy()
                out["_S"], out["_L"], out["_H"] = S, L, H
                out["_first"] = new
                out["_part"] = part
                out["__run_no"] = runs_seen - 1 + g
                nn = np.zeros(n, dtype=bool)
                nn[:-1] = new[1:]
                out["__new_next"] = nn
                if pending is not None:
                    yield _flush(pending, bool(new[0]), False)
                pending = out
            prev_key = tuple(pdf[k].iat[-1] for k in keys)
            carry = (int(S[-1]), int(L[-1]), int(H[-1]))
            runs_seen += int(g[-1])
        if pending is not None:
            yield pending if summary else _flush(pending, True, True)

    return run


def _flush(pdf: pd.DataFrame, closed_at_end: bool, final: bool) -> pd.DataFrame:
    last_of_run = pdf["__new_next"].to_numpy().copy()
    last_of_run[-1] = closed_at_end
    edge = last_of_run & (pdf["__run_no"].to_numpy() == 0)
    if final:
        edge[-1] = True
    pdf["_edge"] = edge
    return pdf.drop(columns=["__new_next", "__run_no"])


def _compose(fs: str, x0) -> F.Column:
    """Fold an array of (p, s, l, h) clamp functions, sorted by p, from x0."""
    return F.aggregate(F.array_sort(F.col(fs)), x0,
                       lambda x, e: F.least(e["h"], F.greatest(e["l"], x + e["s"])))


def clamped_final(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, lo: int, hi: int,
                  out_col: str = "value", partitions: int | None = None) -> DataFrame:
    """Final value of the clamped fold per key, plus the row count ``n``.

    One pass: the kernel emits one (S, L, H, n) row per run per partition, and
    one aggregate composes a key's runs in partition order. A key has at most
    as many runs as partitions it spans, so the gathered list is bounded by
    the partition count, not by the key's row count.
    """
    ranged = _ranged(df, keys, order, partitions)
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("_part", T.IntegerType()), T.StructField("_S", T.LongType()),
        T.StructField("_L", T.LongType()), T.StructField("_H", T.LongType()), T.StructField("_n", T.LongType())])
    runs = ranged.mapInPandas(_clamp_kernel(keys, col, lo, hi, summary=True), schema)
    f = F.struct(F.col("_part").alias("p"), F.col("_S").alias("s"), F.col("_L").alias("l"), F.col("_H").alias("h"))
    agg = runs.groupBy(*keys).agg(F.collect_list(f).alias("fs"), F.sum("_n").alias("n"))
    return agg.select(*keys, _compose("fs", F.lit(0).cast("bigint")).alias(out_col), F.col("n").cast("bigint"))


def clamped_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, lo: int, hi: int,
                    out_col: str = "value", partitions: int | None = None) -> DataFrame:
    """Per row, the value of the fold ``s <- min(hi, max(lo, s + col))`` from
    s = 0 over the key's rows in ``order`` (inclusive of the row).

    The kernel output is checkpointed (reliable, in the shared folder) before
    its two consumers, the rows and the carry table: both must see the same
    range partitioning, and two separate range exchanges may sample
    different bounds.
    """
    ranged = _ranged(df, keys, order, partitions)
    schema = T.StructType(list(df.schema.fields) + [
        T.StructField("_S", T.LongType()), T.StructField("_L", T.LongType()), T.StructField("_H", T.LongType()),
        T.StructField("_first", T.BooleanType()), T.StructField("_part", T.IntegerType()),
        T.StructField("_edge", T.BooleanType())])
    scanned = materialize(ranged.mapInPandas(_clamp_kernel(keys, col, lo, hi, summary=False), schema))
    edges = scanned.filter(F.col("_edge")).select(*keys, "_part", F.struct(
        F.col("_part").alias("p"), F.col("_S").alias("s"), F.col("_L").alias("l"), F.col("_H").alias("h")).alias("f"))
    prev = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (edges.select(*keys, "_part", F.collect_list("f").over(prev).alias("fs"))
             .filter(F.size("fs") > 0)
             .select(*keys, "_part", _compose("fs", F.lit(0).cast("bigint")).alias("_x")))
    at = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), "_x")
    on = F.col("_part") == F.col("_k_part")
    for k in keys:      # rows without a key are a key of their own
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = scanned.join(F.broadcast(at), on, "left")
    x = F.coalesce(F.col("_x"), F.lit(0).cast("bigint"))
    value = F.least(F.col("_H"), F.greatest(F.col("_L"), x + F.col("_S")))
    return j.select(*[F.col(c) for c in df.columns], value.alias(out_col))


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder (reliable
    checkpoint: survives executor loss, no lineage recomputation)."""
    from ..session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
