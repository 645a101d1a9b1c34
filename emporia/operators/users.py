"""user dimension (SCD type 1) from register / patch / disable / delete events.

A user exists from the first register after their last delete; events
before that are errors and ignored. From there each column takes its latest
non-null value (null-skipping patch, C6); a later register acts as a patch
that also enables. One read of the events: running counts per user tell how
often the user had been deleted and whether they are registered since
(``plans.running``: a user with a third of all events lies in many tasks), and
two partial aggregates do the rest, per life of a user and per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fmt_ts
from ..plans.running import running
from ..plans.skew import heavy_keys

SEQ = ["ts", "event_id"]


FIELDS = ["full_name", "email", "phone", "address", "enabled"]


def user_dimension(ev: DataFrame) -> DataFrame:
    heavy = heavy_keys(ev, "user_id")
    one = running(ev, "user_id", SEQ, heavy=heavy, sums={"life": F.col("is_delete").cast("bigint"), "registers": F.col("is_register").cast("bigint")})
    two = running(one, "user_id", SEQ, heavy=heavy, lasts={"before": F.when(F.col("is_delete"), F.col("registers"))})
    at = F.struct(*SEQ)
    alive = ~F.col("is_delete") & (F.col("registers") > F.coalesce("before", F.lit(0)))
    lives = two.groupBy("user_id", "life").agg(
        *[F.max_by(F.col(c), F.when(alive & F.col(c).isNotNull(), at)).alias(c) for c in FIELDS],
        F.min(F.when(alive, at)).alias("reg"), F.max(F.when(alive, at)).alias("upd"))
    last = lives.groupBy("user_id").agg(F.max_by(F.struct(*FIELDS, "reg", "upd"), "life").alias("r")).select("user_id", "r.*")
    return last.where("reg IS NOT NULL").select(
        "user_id", "full_name", "email", "phone", "address", F.coalesce(F.col("enabled"), F.lit(True)).alias("enabled"),
        fmt_ts(F.col("reg.ts")).alias("created_at"), fmt_ts(F.col("upd.ts")).alias("updated_at"))
