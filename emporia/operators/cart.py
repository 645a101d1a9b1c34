"""Cart jobs: replay, view, checkout events, idle sessions.

A cart lives from its first add until 24 h after its last one, or until it is
checked out. Its rules, in event order per user: an add of a product that is
not in the cache is refused and does nothing; any other add raises the
quantity, replaces the line's product snapshot by the row that the cache holds
then, and renews the 24 h; a remove deletes the line; a checkout of a live cart
that is not empty sends an event and empties it.

Every event gets the number of the cart it belongs to (``epoch``): checkouts
before it plus adds so far that came more than 24 h after the add before. Both
are running values over a user's events (``plans.running``: a user with a third
of all events lies in many tasks). The rest is aggregates per cart and line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, fmt_ts, unknown_product_name, unknown_product_price
from ..plans.running import running
from ..plans.skew import asof_join, heavy_keys, validity

SEQ = ["ts", "event_id"]
CART_TTL_SECONDS = 24 * 3600
SNAPSHOT = ["name", "price", "image_url"]


def _ttl(seconds: int) -> F.Column:
    return F.make_dt_interval(secs=F.lit(seconds))


def accepted_events(ev: DataFrame, feed: DataFrame) -> DataFrame:
    """Cart events with the product row that each add finds in the cache; adds
    that find none are refused and left out. A hot SKU is dealt over salts."""
    held = validity(feed, "sku", "ts", ["seq"]).select("sku", *SNAPSHOT, F.lit(True).alias("_found"), "_since", "_until")
    adds = ev.where(F.col("kind") == "add")
    found = asof_join(adds, held, "sku", "ts", heavy_keys(adds, "sku"), how="inner", spread=SEQ).drop("_found")
    none = [F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in SNAPSHOT]
    return found.unionByName(ev.where(F.col("kind") != "add").select("*", *none))


def cart_epochs(ev: DataFrame, ttl: int = CART_TTL_SECONDS, heavy: dict | None = None) -> DataFrame:
    """Accepted events with ``epoch``, ``last_add`` (time of the user's add
    before) and ``live`` (whether a cart exists just before the event)."""
    add, checkout = F.col("kind") == "add", F.col("kind") == "checkout"
    heavy = heavy_keys(ev, "user_id") if heavy is None else heavy
    one = running(ev, "user_id", SEQ, sums={"checkouts": checkout.cast("bigint")},
                  lasts={"last_add": F.when(add, F.col("ts"))}, heavy=heavy)
    late = F.col("ts") > F.col("last_add") + _ttl(ttl)
    two = running(one, "user_id", SEQ, sums={"gaps": F.coalesce(add & late, F.lit(False)).cast("bigint")}, heavy=heavy)
    return two.select(*ev.columns, (F.col("checkouts") - checkout.cast("bigint") + F.col("gaps")).alias("epoch"), "last_add",
                      F.coalesce(~late, F.lit(False)).alias("live"))


def cart_lines(e: DataFrame) -> DataFrame:
    """Per (user, epoch, SKU) what the cart holds at its end: the adds since the
    line's last remove, with the snapshot of the last of them."""
    at = F.struct(*SEQ)
    removed = e.where(F.col("kind") == "remove").groupBy("user_id", "epoch", "sku").agg(F.max(at).alias("removed"))
    adds = (e.where(F.col("kind") == "add").join(removed, ["user_id", "epoch", "sku"], "left")
            .where(F.col("removed").isNull() | (at > F.col("removed"))))
    return adds.groupBy("user_id", "epoch", "sku").agg(
        F.sum("qty").cast("bigint").alias("qty"), F.max_by(F.struct(*SNAPSHOT), at).alias("snapshot")) \
        .select("user_id", "epoch", "sku", "qty", "snapshot.*")


def cart_replay(ev: DataFrame, feed: DataFrame, as_of=None, ttl: int = CART_TTL_SECONDS) -> DataFrame:
    """F4 + E5 (+ D3): the carts that are live at ``as_of`` (a Python datetime;
    by default the last event's time): one row per (user, SKU)."""
    if as_of is None:
        as_of = ev.agg(F.max("ts")).first()[0]
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    e = cart_epochs(accepted_events(ev.where(F.col("ts") <= now), feed), ttl)
    after = F.col("epoch") + (F.col("kind") == "checkout").cast("bigint")
    current = e.groupBy("user_id").agg(F.max(after).alias("epoch"), F.max(F.when(F.col("kind") == "add", F.col("ts"))).alias("last_add")) \
        .where(F.col("last_add") + _ttl(ttl) >= now).select("user_id", "epoch")
    return cart_lines(e).join(current, ["user_id", "epoch"]).drop("epoch")


def cart_view(cart: DataFrame) -> DataFrame:
    """D3 (+C4): cart lines with the snapshot of their last add; a line whose
    snapshot lacks a field gets the fixed default name and price 0."""
    return cart.select("user_id", "sku", "qty", unknown_product_name(F.col("name")).alias("product_name"),
                       unknown_product_price(F.col("price")).alias("price"), "image_url")


def cart_checkout_lines(ev: DataFrame, feed: DataFrame, ttl: int = CART_TTL_SECONDS) -> DataFrame:
    """I4 + B6, flat: one row per (checkout, SKU) with the cart's quantity and
    price; the checkout of an empty or expired cart sends no event (B6)."""
    e = cart_epochs(accepted_events(ev, feed), ttl)
    checkouts = (e.where((F.col("kind") == "checkout") & F.col("live"))
                 .select("user_id", "epoch", F.col("event_id").alias("checkout_id")))
    return (checkouts.join(cart_lines(e), ["user_id", "epoch"])
            .select("user_id", "checkout_id", "sku", "qty", unknown_product_price(F.col("price")).alias("price")))


def cart_checkout(ev: DataFrame, feed: DataFrame) -> DataFrame:
    """I4: checkout events with their item array (sorted by SKU).

    The array is gathered *after* aggregating to one row per (checkout, SKU),
    so its length is bounded by the catalogue, not by the event volume.
    """
    li = cart_checkout_lines(ev, feed)
    item = F.struct(F.col("sku"), F.col("qty").cast("int").alias("qty"), F.col("price").cast(MONEY).alias("price"))
    return (li.groupBy("user_id", "checkout_id")
            .agg(F.array_sort(F.collect_list(item)).alias("items")))


def items_text(items: F.Column, with_price: bool = True) -> F.Column:
    """Render an item array as 'sku:qty[:price];...' (arrays already sorted)."""
    if with_price:
        f = lambda x: F.concat_ws(":", x["sku"], x["qty"].cast("string"), x["price"].cast("string"))
    else:
        f = lambda x: F.concat_ws(":", x["sku"], x["qty"].cast("string"))
    return F.array_join(F.transform(items, f), ";")


def cart_sessions(ev: DataFrame, feed: DataFrame, ttl: int = CART_TTL_SECONDS) -> DataFrame:
    """J5 (batch form): one row per cart, from its first add to its checkout or
    else 24 h after its last add (every add renews it, a remove does not)."""
    e = cart_epochs(accepted_events(ev, feed), ttl)
    of = e.where(F.col("kind") != "remove").groupBy("user_id", "epoch").agg(
        F.min(F.when(F.col("kind") == "add", F.col("ts"))).alias("start"), F.max(F.when(F.col("kind") == "add", F.col("ts"))).alias("last"),
        F.min(F.when((F.col("kind") == "checkout") & F.col("live"), F.col("ts"))).alias("checkout"),
        F.count(F.when(F.col("kind") == "add", 1)).alias("n_adds"),
        F.sum(F.when(F.col("kind") == "add", F.col("qty"))).cast("bigint").alias("qty")).where("n_adds > 0")
    return of.select("user_id", fmt_ts(F.col("start")).alias("session_start"),
                     fmt_ts(F.coalesce("checkout", F.col("last") + _ttl(ttl))).alias("session_end"),
                     F.col("checkout").isNotNull().alias("checked_out"), F.col("n_adds").cast("bigint").alias("n_adds"), "qty")
