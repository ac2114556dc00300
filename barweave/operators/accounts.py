"""Users and subscriptions from billing events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

FREE = "free"
PRO = "pro"
EVENT_SCHEMA = """type string, data struct<object: struct<client_reference_id: string, customer: string, subscription: string, id: string,
status: string, current_period_end: bigint, metadata: struct<user_id: string>>>"""


def upsert_users(existing: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per normalised e-mail; an existing row keeps its tier and name.

    ``visits`` has email and display_name; a new user starts on the free tier.
    """
    email = F.lower(F.trim("email"))
    seen = visits.withColumn("email", email).where(c("email") != "").groupBy("email").agg(F.max("display_name").alias("display_name"))
    known = existing.select(email.alias("email"), c("display_name").alias("_name"), "tier")
    merged = known.join(seen, "email", "full")
    blank = lambda x: F.when(F.trim(x) != "", x)
    default_name = F.substring_index("email", "@", 1)
    return merged.select(
        "email",
        F.coalesce(blank(c("_name")), blank(c("display_name")), default_name).alias("display_name"),
        F.coalesce("tier", F.lit(FREE)).alias("tier"),
    )


def parse_events(raw: DataFrame) -> DataFrame:
    """Flatten event documents (column ``payload``, with ``event_ts`` and ``event_id``).

    Events of other types, or without a user, are dropped.
    """
    doc = raw.withColumn("e", F.from_json("payload", EVENT_SCHEMA)).select("event_ts", "event_id", "e.type", "e.data.object.*")
    checkout = c("type") == "checkout.session.completed"
    updated = c("type") == "customer.subscription.updated"
    deleted = c("type") == "customer.subscription.deleted"
    blank = lambda x: F.when(F.trim(x) != "", x)
    user = F.when(checkout, F.coalesce(blank(c("client_reference_id")), c("metadata.user_id"))).otherwise(c("metadata.user_id"))
    status = F.when(checkout, "active").when(updated, F.coalesce(blank(c("status")), F.lit("inactive"))).when(deleted, "canceled")
    return doc.select(
        F.try_to_number(user, F.lit("999999999999999999")).cast("long").alias("user_id"),
        "event_ts",
        "event_id",
        blank(c("customer")).alias("customer_id"),
        blank(F.when(checkout, c("subscription")).otherwise(c("id"))).alias("subscription_id"),
        status.alias("status"),
        F.when(updated, F.timestamp_seconds(c("current_period_end"))).alias("period_end"),
    ).where((c("user_id") > 0) & c("status").isNotNull())


def fold_events(events: DataFrame) -> DataFrame:
    """Latest state per user: ids and period end keep their last known value.

    Every output is a max_by, so users with many events combine before the shuffle.
    """
    order = F.struct("event_ts", "event_id")
    keep = lambda x: F.max_by(x, F.when(c(x).isNotNull(), order)).alias(x)
    out = events.groupBy("user_id").agg(
        F.max_by("status", order).alias("status"),
        keep("customer_id"),
        keep("subscription_id"),
        keep("period_end"),
        F.max("event_ts").alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return out.withColumn("tier", F.when(c("status") == "active", PRO).otherwise(FREE))


def status(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Users with their subscription; the subscription's tier wins where there is one."""
    subs = subscriptions.select("user_id", c("tier").alias("_tier"), c("status").alias("subscription_status"), "period_end")
    stored = F.when(F.trim("tier") != "", c("tier"))
    joined = users.join(subs, "user_id", "left").withColumn("tier", F.coalesce("_tier", stored, F.lit(FREE))).drop("_tier")
    return joined.withColumn("is_pro", c("tier") == PRO)
