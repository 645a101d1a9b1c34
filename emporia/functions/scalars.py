"""Scalar column functions (inventory C1-C14).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for results to match.
# ---------------------------------------------------------------------------
INT_MAX = 2147483647                      # upper clamp of the stock fold
MONEY = "decimal(18,2)"                   # money type of every price / total
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"         # rendering of dates in documents
UNKNOWN_PRODUCT_NAME = "Sản phẩm không rõ"  # cart line whose SKU has no snapshot
STATUS_PENDING = "PENDING"
STATUS_VALIDATED = "VALIDATED"
STATUS_COMPLETED = "COMPLETED"
STATUS_FAILED = "FAILED"
STATUS_PAYMENT_FAILED = "PAYMENT_FAILED"
MSG_ORDER_PLACED = "Đơn hàng đã được tiếp nhận!"
MSG_PAYMENT_OK = "Thanh toán thành công! Đơn hàng hoàn tất."
MSG_OUT_OF_STOCK_PREFIX = "Hết hàng: "
MSG_PAYMENT_FAILED_PREFIX = "Thanh toán lỗi: "
PAYMENT_DECLINED_REASON = "Payment gateway declined."
COMPENSATION_PREFIX = "COMPENSATION: Payment Failed for Order "
ERR_SKU_REQUIRED = "skuCode required"
ERR_QTY_REQUIRED = "adjustmentQuantity required"
ERR_INVALID_JSON = "Invalid JSON"
ERR_ZERO = "Adjustment cannot be zero"
ERR_NEGATIVE = "Inventory cannot be negative"
WARMUP_INITIAL_QUANTITY = 1000
UPDATE_INITIAL_QUANTITY = 0
# ---------------------------------------------------------------------------


def line_amount(price: Column, qty: Column) -> Column:
    """Exact decimal price x quantity."""
    return (price.cast(MONEY) * qty.cast("decimal(10,0)")).cast("decimal(28,2)")


def price_fallback(variant_price: Column, base_price: Column) -> Column:
    """Variant price, else the product's base price."""
    return F.coalesce(variant_price, base_price).cast(MONEY)


def image_fallback(variant_image: Column, product_image: Column) -> Column:
    """Variant image, else the product image."""
    return F.coalesce(variant_image, product_image)


def unknown_product_name(name: Column) -> Column:
    """C4: default name for a SKU with no product snapshot."""
    return F.coalesce(name, F.lit(UNKNOWN_PRODUCT_NAME))


def unknown_product_price(price: Column) -> Column:
    """C4: default price 0 for a SKU with no product snapshot."""
    return F.coalesce(price.cast(MONEY), F.lit(0).cast(MONEY))


def active_default(is_active: Column) -> Column:
    """A missing active flag means active."""
    return F.coalesce(is_active, F.lit(True))


def patch(new: Column, old: Column) -> Column:
    """Null-skipping patch of one column."""
    return F.coalesce(new, old)


def floor_zero(q: Column) -> Column:
    """Initial quantity floored at 0; a missing quantity stays missing."""
    return F.when(q.isNotNull(), F.greatest(F.lit(0).cast("bigint"), q.cast("bigint")))


def not_enough_stock_reason(sku: Column, need: Column, have: Column) -> Column:
    """Refusal text of a reservation."""
    return F.format_string("Not enough stock for %s (need %d, have %d)", sku, need, have)


def compensation_reason(order_number: Column) -> Column:
    """Reason text of a restock after a payment failure."""
    return F.concat(F.lit(COMPENSATION_PREFIX), order_number)


def tolerant_int(x: Column) -> Column:
    """C11: integer from int / long / numeric text; null when it is not one."""
    s = F.trim(x.cast("string"))
    # Integer text only: optional sign and digits (no fraction, no exponent).
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))


def status_message(status: Column, reason: Column) -> Column:
    """Status -> notification message."""
    return (F.when(status == STATUS_PENDING, F.lit(MSG_ORDER_PLACED))
            .when(status == STATUS_COMPLETED, F.lit(MSG_PAYMENT_OK))
            .when(status == STATUS_FAILED, F.concat(F.lit(MSG_OUT_OF_STOCK_PREFIX), F.coalesce(reason, F.lit("null"))))
            .when(status == STATUS_PAYMENT_FAILED,
                  F.concat(F.lit(MSG_PAYMENT_FAILED_PREFIX), F.coalesce(reason, F.lit("null")))))


def replay_safe_id(*cols: Column) -> Column:
    """Deterministic id in place of a random UUID, so replays agree."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def cut_to_brace(raw: Column) -> Column:
    """C14: null -> ''; text from the first '{' when there is one; else unchanged."""
    pos = F.instr(raw, "{")
    return (F.when(raw.isNull(), F.lit(""))
            .when(pos > 0, raw.substr(pos, F.length(raw)))
            .otherwise(raw))


def fmt_ts(ts: Column) -> Column:
    """Render a timestamp the way the documents do."""
    return F.date_format(ts, TS_FORMAT)
