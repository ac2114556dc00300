"""Alert selection, message text and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.operators import store

c = F.col

STRONG = ["STRONG_BUY", "STRONG_SELL"]
MEMORY = "2 days"


def select(signals: DataFrame) -> DataFrame:
    """Tradable signals of the strong classes with a full key."""
    return signals.where(
        F.upper("signal").isin(STRONG)
        & F.coalesce(c("trading_allowed"), F.lit(True))
        & (c("ticker") != "")
        & c("trade_date").isNotNull()
    )


def unsent(signals: DataFrame, sent: DataFrame) -> DataFrame:
    """The newest version (by ``batch_id``, where there is one) of each key that is not in the sent log."""
    key = ["ticker", "trade_date"]
    order = c("batch_id") if "batch_id" in signals.columns else F.lit(0)
    return store.current(signals, order).select(*signals.columns).join(sent.select(*key), key, "left_anti").select(*signals.columns)


def subscribers(users: DataFrame) -> DataFrame:
    """Reachable users of the pro tier (or without a tier)."""
    reachable = (F.trim(F.coalesce("chat_id", F.lit(""))) != "") | (F.trim(F.coalesce("email", F.lit(""))) != "")
    return users.where(reachable & F.trim(F.coalesce("tier", F.lit(""))).isin("", "pro"))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("—"))


def message(df: DataFrame) -> Column:
    """Four-line message of a signal."""
    icon = F.when(c("signal").endswith("BUY"), "▲").otherwise("▼")
    words = F.replace("signal", F.lit("_"), F.lit(" "))
    rr = F.coalesce(F.concat(F.lit("1:"), c("risk_reward").cast("string")), F.lit("—"))
    return F.concat_ws(
        "\n",
        F.concat(icon, F.lit(" "), "ticker"),
        F.concat(words, F.lit(" · conviction "), _text(c("conviction_pct")), F.lit("%")),
        F.concat(F.lit("Entry "), _text(c("entry")), F.lit(" · SL "), _text(c("stop_loss")), F.lit(" · TP1 "), _text(c("tp1")),
                 F.lit(" · TP2 "), _text(c("tp2"))),
        F.concat(F.lit("R/R "), rr, F.lit(" · regime "), _text(c("regime"))),
    )


def with_messages(df: DataFrame) -> DataFrame:
    """Add ``body``, ``subject`` and ``html``."""
    df = df.withColumn("body", message(df))
    html = F.concat(F.lit("<div>"), F.replace("body", F.lit("\n"), F.lit("<br/>")), F.lit("</div>"))
    subject = F.concat(c("ticker"), F.lit(" · "), F.replace("signal", F.lit("_"), F.lit(" ")))
    return df.withColumns({"subject": subject, "html": html})


def audience(users: DataFrame) -> DataFrame:
    """One row: ``channels``, an array of (channel, recipients)."""
    has = lambda name: F.count_if(F.trim(F.coalesce(name, F.lit(""))) != "").alias("recipients")
    chat = F.struct(F.lit("chat").alias("channel"), has("chat_id"))
    email = F.struct(F.lit("email").alias("channel"), has("email"))
    return subscribers(users).agg(F.array(chat, email).alias("channels"))


def outbox(signals: DataFrame, users: DataFrame) -> DataFrame:
    """One message per signal and channel, addressed to that channel's audience.

    The audience (``subscribers`` by channel) is resolved at delivery, so the
    outbox grows with the signals and not with signals times users.
    """
    sent = signals.withColumn("_channels", audience(users).scalar()).withColumn("_c", F.explode("_channels"))
    return sent.select(*signals.columns, "_c.*").where(c("recipients") > 0)


def summary(selected: DataFrame, fresh: DataFrame, users: DataFrame) -> DataFrame:
    """Messages sent and signals skipped because they were sent before."""
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    counted = selected.agg(F.count(F.lit(1)).alias("_selected")).withColumn("_fresh", size(fresh))
    sent = (c("_fresh") * size(subscribers(users))).alias("sent")
    return counted.select(sent, (c("_selected") - c("_fresh")).alias("skipped"))
