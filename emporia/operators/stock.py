"""Stock ledger jobs: change union, clamped fold, intake checks, lookup.

The stock of a SKU is the ordered fold ``s <- clamp(s + change, 0, 2^31-1)``
from 0. Because of the clamp a plain ``sum`` is wrong; the fold runs on the
skew-safe range scan (``plans.scan.clamped_running``), which is exact for
both clamp bounds and splits a hot SKU over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (ERR_INVALID_JSON, ERR_NEGATIVE, ERR_QTY_REQUIRED, ERR_SKU_REQUIRED, ERR_ZERO,
                                 INT_MAX, fmt_ts, floor_zero, tolerant_int)
from ..plans.scan import clamped_final, clamped_running
from ..plans.skew import split_join

CHANGE_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "chg"]


def stock_changes(created: DataFrame, adjustments: DataFrame) -> DataFrame:
    """G1 (+C7): created events (initial quantity floored at 0) union all
    adjustment events, re-keyed by SKU. Narrow: no shuffle until a fold."""
    c = created.select("sku", floor_zero(F.col("initial_quantity")).alias("chg"), "ts", "l_orderkey",
                       "l_linenumber", "l_suppkey", F.lit("created").alias("source"))
    a = adjustments.select("sku", F.col("adjustment_quantity").cast("bigint").alias("chg"), "ts", "l_orderkey",
                           "l_linenumber", "l_suppkey", F.lit("adjustment").alias("source"))
    return c.unionByName(a)


def foldable(changes: DataFrame) -> DataFrame:
    """Changes that a fold may see. A change without SKU or quantity says
    nothing about any stock; :func:`unfoldable` has the rest (A4)."""
    return changes.where(F.col("sku").isNotNull() & F.col("chg").isNotNull())


def unfoldable(changes: DataFrame) -> DataFrame:
    """A4: the changes kept out of the folds, with the reason."""
    return changes.where(F.col("sku").isNull() | F.col("chg").isNull()).withColumn(
        "error", F.when(F.col("sku").isNull(), F.lit(ERR_SKU_REQUIRED)).otherwise(F.lit(ERR_QTY_REQUIRED)))


def stock_running(changes: DataFrame, order=CHANGE_ORDER) -> DataFrame:
    """stock after every change (the fold's per-step log)."""
    return clamped_running(foldable(changes), ["sku"], list(order), "chg", 0, INT_MAX, out_col="stock")


def stock_level(changes: DataFrame, order=CHANGE_ORDER) -> DataFrame:
    """Final stock per SKU: one range-partitioned pass composing each
    SKU's clamp steps (no per-row output, no join)."""
    f = clamped_final(foldable(changes), ["sku"], list(order), "chg", 0, INT_MAX, out_col="stock")
    return f.select("sku", F.col("stock").cast("bigint").alias("stock"), F.col("n").alias("n_changes"))


def adjustment_validate(raw: DataFrame) -> DataFrame:
    """Intake check of a raw adjustment body; first failing rule wins:
    unparseable JSON; no skuCode; no adjustmentQuantity; quantity not an
    integer ("Invalid JSON"); zero."""
    body = F.col("body")
    keys = F.json_object_keys(body)
    qty_text = F.get_json_object(body, "$.adjustmentQuantity")
    delta = tolerant_int(qty_text)
    error = (F.when(keys.isNull(), F.lit(ERR_INVALID_JSON))
             .when(~F.array_contains(keys, "skuCode"), F.lit(ERR_SKU_REQUIRED))
             .when(~F.array_contains(keys, "adjustmentQuantity"), F.lit(ERR_QTY_REQUIRED))
             .when(delta.isNull(), F.lit(ERR_INVALID_JSON))
             .when(delta == 0, F.lit(ERR_ZERO)))
    out = raw.select("event_id", "body", error.alias("error"), F.get_json_object(body, "$.skuCode").alias("sku_"),
                     delta.alias("delta_"))
    ok = F.col("error").isNull()
    return out.select("event_id", "body", F.when(ok, F.col("sku_")).alias("sku"),
                      F.when(ok, F.col("delta_")).alias("delta"), "error")


def requested_changes(raw: DataFrame) -> DataFrame:
    """Adjustment bodies as stock changes, as far as they can be read: what is
    missing stays null, for the folds to be kept out of (A4)."""
    body = F.col("body")
    return raw.select(F.get_json_object(body, "$.skuCode").alias("sku"),
                      tolerant_int(F.get_json_object(body, "$.adjustmentQuantity")).cast("bigint").alias("chg"), "ts",
                      F.col("event_id").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(0).cast("bigint").alias("l_suppkey"),
                      F.lit("request").alias("source"))


def adjustment_reject_negative(valid: DataFrame, stock: DataFrame, heavy: dict[str, int] | None = None) -> DataFrame:
    """Reject when current + delta < 0; a SKU with no stock row counts 0.

    ``stock`` is one row per SKU (catalogue-sized); the requests of a hot SKU
    (``heavy``) are dealt over salts.
    """
    j = split_join(valid, stock.select("sku", "stock"), "sku", heavy or {}, spread=["event_id"])
    current = F.coalesce(F.col("stock"), F.lit(0)).cast("bigint")
    accepted = current + F.col("delta") >= 0
    return j.select("event_id", "sku", F.col("delta").cast("int").alias("delta"), current.alias("current"),
                    accepted.alias("accepted"), F.when(~accepted, F.lit(ERR_NEGATIVE)).alias("error"))


def write_stock_table(stock: DataFrame, path: str) -> None:
    """J9 materialisation: latest stock per SKU, clustered and sorted by SKU
    so a point lookup touches one file and skips row groups by min/max."""
    (stock.select("sku", "stock").repartitionByRange("sku").sortWithinPartitions("sku")
     .write.mode("overwrite").parquet(path))


def stock_lookup(spark, path: str, skus: DataFrame) -> DataFrame:
    """Read the current stock of the given SKUs; unknown SKU -> 0."""
    table = spark.read.parquet(path)
    return (skus.select("sku").join(table, "sku", "left")
            .select("sku", F.coalesce(F.col("stock"), F.lit(0)).cast("bigint").alias("quantity")))


def render_running(run: DataFrame) -> DataFrame:
    return run.select("sku", "source", fmt_ts(F.col("ts")).alias("ts"), "l_orderkey", "l_linenumber", "l_suppkey",
                      "chg", F.col("stock").cast("bigint").alias("stock"))
