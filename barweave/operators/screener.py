"""Ranking and filtering of scanned signals; entitlements."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators.features import MODEL_FEATURES
from barweave.operators.signals import build, latest

c = F.col

# Plan limits.
FREE_TICKERS = ["AAPL", "TSLA", "BTC-USD"]
LIMITS = [
    ("pro", 50, ["sp500", "ndx100", "fx_major", "crypto20"], True, 0),
    ("free", 5, ["sp500"], False, 24),
]
PUBLIC_COLUMNS = [
    "ticker", "date", "signal", "side", "prob_up", "confidence_pct", "conviction_pct", "entry", "stop_loss", "risk_reward",
    "position_size_pct", "regime", "trading_allowed", "price", "atr_pct", "volume_ratio",
]


def scan(signals: DataFrame, features: DataFrame, names: list[str] = MODEL_FEATURES) -> DataFrame:
    """The signal of each ticker's newest bar, with its rsi, if it has levels and all features ``names`` of that bar are there.

    A ticker without them could not be scored, so it has no row.
    """
    newest = latest(signals).where(c("entry").isNotNull()).drop("rsi")
    # the newest bars' features only: the rest never reaches the join
    complete = features.select("ticker", "date", *names).join(newest.select("ticker", "date"), ["ticker", "date"], "left_semi").dropna(how="any", subset=names)
    return newest.join(complete.select("ticker", "date", *(["rsi"] if "rsi" in names else [])), ["ticker", "date"])


#: What a cycle keeps of a signal.
CYCLE = [
    "ticker", "date", "signal", "side", "prob_up", "confidence_pct", "conviction_pct", "price", "atr_pct", "entry", "stop_loss", "tp1", "tp2", "risk_reward",
    "position_size_pct", "regime", "trading_allowed", "notes",
]


def cycle(bars: DataFrame, features: DataFrame, vix: DataFrame, model, calibrator=None, names: list[str] = MODEL_FEATURES) -> DataFrame:
    """The signals of each ticker's newest bar, scored now: model, calibration, regime, grade, levels, size.

    A ticker whose newest bar lacks one of the features ``names`` can't be scored and has no row.
    """
    complete = latest(features).dropna(how="any", subset=names)
    scored = model.transform(complete.select("ticker", "date", *names))
    if calibrator is not None:
        scored = calibrator.transform(scored).withColumn("prob_up", c("prob_cal"))
    scored = scored.select("ticker", "date", "prob_up")
    graded = build(bars.drop("prob_up").join(scored, ["ticker", "date"], "left"), vix).where(c("prob_up").isNotNull())
    named = {"tp1": c("tp1_level"), "tp2": F.element_at("take_profits.price", -1), "regime": c("status")}
    return graded.withColumns(named).select(*CYCLE).join(complete.select("ticker", "date", "volume_ratio", "rsi"), ["ticker", "date"])


def ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(c("conviction_pct").desc(), "ticker")


def _at_least(name: str):
    return lambda bound: c(name) >= bound


#: What each option of ``matching`` asks of a row; a null measure never meets a bound.
_ASKS = {
    "only_tradable": lambda wanted: F.coalesce(c("trading_allowed"), F.lit(True)) if wanted else F.lit(True),
    "watchlist": lambda names: F.upper("ticker").isin([n.strip().upper() for n in names]),
    "min_volume_ratio": _at_least("volume_ratio"),
    "min_conviction": _at_least("conviction_pct"),
    "min_confidence": _at_least("confidence_pct"),
    "max_atr_pct": lambda bound: c("atr_pct") <= bound,
    "signal": lambda name: c("signal") == name.upper() if name else F.lit(True),
    "side": lambda name: c("side") == name if name in ("long", "short") else F.lit(True),
}


def matching(df: DataFrame, members: DataFrame | None = None, limit: int | None = None, **options) -> DataFrame:
    """Rows that meet all ``options`` (see ``_ASKS``; None asks nothing).

    ``members`` keeps the tickers of a frame (a sector, say), ``limit`` the
    strongest rows.
    """
    asked = [_ASKS[name](value) for name, value in options.items() if value is not None]
    found = df.where(reduce(and_, asked)) if asked else df
    if members is not None:
        found = found.join(members.select("ticker"), "ticker", "left_semi")
    return ranked(found).limit(limit) if limit else found


def counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c("side") == "long").alias("buy_count"),
        F.count_if(c("side") == "short").alias("sell_count"),
        F.count_if(~c("trading_allowed")).alias("suspended_count"),
    )


def top(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` tradable signals with the highest conviction."""
    return ranked(df.where("trading_allowed")).limit(n)


def public_view(df: DataFrame, n: int = 50) -> DataFrame:
    """Light columns of the ``n`` strongest signals, for hot reads."""
    return ranked(df).limit(n).select(*PUBLIC_COLUMNS)


def priority_queue(universe: DataFrame, watchlists: DataFrame) -> DataFrame:
    """Universe order with watched tickers first. A universe is a bounded list."""
    watched = watchlists.select(F.explode("tickers").alias("_key")).distinct().withColumn("prioritised", F.lit(True))
    joined = universe.withColumn("_key", F.upper("ticker")).join(watched, "_key", "left")
    flagged = joined.withColumn("prioritised", F.coalesce("prioritised", F.lit(False)))
    order = Window.orderBy(c("prioritised").desc(), "ticker")
    return flagged.select("ticker", "prioritised", F.row_number().over(order).cast("long").alias("position"))


def visible(requests: DataFrame, free_tickers: list[str] = FREE_TICKERS) -> DataFrame:
    """Requests a user's tier may see: all for pro, the open tickers otherwise."""
    free = [x.upper() for x in free_tickers]
    return requests.where((c("tier") == "pro") | F.upper("ticker").isin(free))


def with_limits(users: DataFrame) -> DataFrame:
    """Attach the plan limits (a two-row table)."""
    schema = "plan string, max_watchlist_tickers int, universes array<string>, alerts boolean, delayed_hours int"
    limits = users.sparkSession.createDataFrame(LIMITS, schema)
    plan = F.when(c("tier") == "pro", "pro").otherwise("free")
    return users.withColumn("plan", plan).join(F.broadcast(limits), "plan")
