"""Event decoding (A2), multi-topic dispatch (A3), failure isolation (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PAYMENT_DECLINED_REASON, cut_to_brace, replay_safe_id

# ---------------------------------------------------------------------------
# Topic names must equal the reference's. The topics the order
# listener handles, and what each one triggers; any other topic is dropped.
# ---------------------------------------------------------------------------
PLACED_TOPIC, FAILED_TOPIC = "order-placed-topic", "order-failed-topic"
PAID_TOPIC, DECLINED_TOPIC = "payment-processed-topic", "payment-failed-topic"
VALIDATED_TOPIC = "order-validated-topic"
HANDLED_TOPICS = {
    PLACED_TOPIC: "placement",
    FAILED_TOPIC: "failure",
    PAID_TOPIC: "payment_success",
    DECLINED_TOPIC: "payment_failure",
}
# Union of the event fields the handled topics carry (unknown fields are ignored).
EVENT_SCHEMA = ("orderNumber STRING, userId BIGINT, orderLineItemsDtoList ARRAY<STRUCT<skuCode: STRING, quantity: INT>>, "
                "reason STRING, paymentId STRING")
# ---------------------------------------------------------------------------
ERR_UNDECODABLE = "undecodable event"


def decode_payload(raw: DataFrame, schema: str = "k INT") -> DataFrame:
    """A2 (+C14): lenient JSON decode: bytes before the first '{' dropped,
    null -> '', no brace -> unchanged; unparseable -> null fields, not an error."""
    cleaned = cut_to_brace(F.col("raw"))
    parsed = F.from_json(cleaned, schema, {"mode": "PERMISSIVE"})
    return raw.select("event_id", cleaned.alias("cleaned"), parsed.alias("p")).select("event_id", "cleaned", "p.*")


def topic_feed(placed: DataFrame, log: DataFrame) -> DataFrame:
    """The order events as a keyed topic stream ``(topic, key, value)``;
    ``placed`` has the items of each order.

    Payment ids are derived (C13) so a replay produces the same value.
    """
    items = F.transform("items", lambda x: F.struct(x["sku"].alias("skuCode"), x["qty"].alias("quantity")))
    number = F.col("order_number").alias("orderNumber")
    p = placed.select(F.lit(PLACED_TOPIC).alias("topic"), F.col("order_number").alias("key"),
                      F.to_json(F.struct(number, F.col("user_id").alias("userId"), items.alias("orderLineItemsDtoList"))).alias("value"))
    kind = F.col("kind")
    topic = (F.when(kind == "FAILED", FAILED_TOPIC).when(kind == "PAID", PAID_TOPIC)
             .when(kind == "PAY_FAILED", DECLINED_TOPIC).otherwise(VALIDATED_TOPIC))
    body = (F.when(kind == "PAID", F.to_json(F.struct(number, replay_safe_id(F.lit("pay"), F.col("order_number")).alias("paymentId"))))
            .when(kind == "PAY_FAILED", F.to_json(F.struct(number, F.lit(PAYMENT_DECLINED_REASON).alias("reason"))))
            .otherwise(F.to_json(F.struct(number))))
    q = log.select(topic.alias("topic"), F.col("order_number").alias("key"), body.alias("value"))
    return p.unionByName(q)


def _decoded(feed: DataFrame) -> DataFrame:
    """Events of the handled topics; ``ok`` where the value is an event of an order."""
    handler = F.create_map(*[x for kv in HANDLED_TOPICS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    ev = F.from_json(cut_to_brace(F.col("value")), EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    return (feed.withColumn("handler", handler[F.col("topic")]).where(F.col("handler").isNotNull()).withColumn("e", ev)
            .withColumn("ok", F.col("e.orderNumber").isNotNull()))


def event_dispatch(feed: DataFrame) -> DataFrame:
    """A3: one fan-in of several topics, dispatched by topic name; a topic
    nobody handles is dropped, an event that cannot be decoded reaches no
    handler (:func:`event_quarantine`)."""
    detail = F.coalesce(F.col("e.reason"), F.col("e.paymentId"), F.col("e.userId").cast("string"))
    items = F.col("e.orderLineItemsDtoList")
    return _decoded(feed).where("ok").select(
        F.col("e.orderNumber").alias("order_number"), "handler", detail.alias("detail"),
        F.when(items.isNotNull(), F.size(items)).cast("bigint").alias("n_items"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"]).alias("total_qty"))


def event_quarantine(feed: DataFrame) -> DataFrame:
    """A4: the events of handled topics that cannot be decoded, as they came."""
    return _decoded(feed).where("NOT ok").select("topic", "key", "value", F.lit(ERR_UNDECODABLE).alias("error"))


def quarantine_split(validated: DataFrame):
    """A4: per-record failure isolation. Returns (good, quarantine); a bad
    record is routed, as it came, to the quarantine table and the batch goes on."""
    good = validated.filter(F.col("error").isNull()).select("event_id", "sku", "delta")
    bad = validated.filter(F.col("error").isNotNull()).select("event_id", "body", "error")
    return good, bad


def write_split(good: DataFrame, bad: DataFrame, base: str) -> tuple[str, str]:
    """Both sinks of A4 (overwrite = idempotent for a replayed batch)."""
    g, b = f"{base}/good", f"{base}/quarantine"
    good.write.mode("overwrite").parquet(g)
    bad.write.mode("overwrite").parquet(b)
    return g, b
