"""Graded trade signals from a calibrated up-probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import div
from barweave.operators import levels, regime
from barweave.operators.features import atr, layered, volume

c = F.col

STRONG_MARGIN = 0.55


def grade(prob_up: Column) -> Column:
    """Four classes, no neutral band. The lower bound is 1 - 0.55 in doubles."""
    return (
        F.when(prob_up >= STRONG_MARGIN, "STRONG_BUY")
        .when(prob_up >= 0.5, "BUY")
        .when(prob_up <= F.lit(1.0) - F.lit(STRONG_MARGIN), "STRONG_SELL")
        .otherwise("SELL")
    )


def side(prob_up: Column) -> Column:
    return F.when(prob_up >= 0.5, "long").otherwise("short")


def conviction(prob_up: Column) -> Column:
    """Distance from one half, 0 to 100."""
    return F.abs(prob_up - 0.5) * 200


def confidence(prob_up: Column) -> Column:
    """Probability of the announced side in percent."""
    return F.greatest(prob_up, 1 - prob_up) * 100


def add_grade(df: DataFrame) -> DataFrame:
    p = c("prob_up")
    return df.withColumns(
        {"signal": grade(p), "side": side(p), "confidence_pct": confidence(p), "conviction_pct": conviction(p)}
    )


def latest(df: DataFrame) -> DataFrame:
    """The last row of each ticker: newest dates by hash aggregation, then a join back."""
    return df.join(df.groupBy("ticker").agg(F.max("date").alias("date")), ["ticker", "date"])


def measured(bars: DataFrame, vix: DataFrame, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """Bars with both ATR flavours, volume ratio and regime."""
    steps = [layered(atr, regime.range_and_gap, volume)]
    out = panel.windowed(bars, steps, back=panel.WARMUP_ROWS, rows=rows)
    usable = F.coalesce(F.when(c("atr") > 0, c("atr")), F.when((c("seq") > 20) & (c("atr_sma") > 0), c("atr_sma")))
    return regime.classify(regime.join_vix_asof(out.withColumn("atr", usable), vix))


def apply_regime(df: DataFrame) -> DataFrame:
    """Scale the size by the regime; a suspended signal stays visible but not tradable."""
    note = (
        F.when(c("status") == "suspended", "regime suspended: signal shown but not tradable")
        .when(c("status") == "caution", "regime caution: size halved")
    )
    return df.withColumns({"position_size_pct": c("base_size_pct") * c("position_scale"), "regime_note": note})


def build(bars: DataFrame, vix: DataFrame, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """The full signal of each ticker's latest bar.

    Levels come from all pivots of the ticker's history.
    """
    now = regime.add_reasons(panel.newest(measured(panel.tail(bars), vix, rows)))
    zoned = levels.zone_arrays(levels.zones(levels.pivots(bars, rows=rows)))
    empty = F.array().cast("array<double>")
    df = add_grade(now).withColumn("price", c("close")).join(zoned, "ticker", "left")
    df = df.withColumns({k: F.coalesce(c(k), empty) for k in ("supports", "resistances")})
    df = apply_regime(levels.add_levels(df.withColumn("atr_pct", div(c("atr"), c("price")) * 100)))
    notes = F.array_compact(
        F.array(
            F.when(c("tp1_cap").isNotNull(), "TP1 capped by a price level"),
            F.when(c("tp2_wall").isNotNull(), "a price level lies before TP2; reward/risk takes precedence"),
            c("regime_note"),
        )
    )
    shown = {k: F.when(c("entry").isNotNull(), levels.tail(c(k))).otherwise(empty) for k in ("supports", "resistances")}
    return df.withColumns({"notes": notes, "all_supports": c("supports"), "all_resistances": c("resistances"), **shown})


def signal_history(bars: DataFrame, vix: DataFrame, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """A signal for every bar, with the volatility-based levels used without structure."""
    empty = F.array().cast("array<double>")
    df = add_grade(measured(bars, vix, rows)).withColumns(
        {"price": c("close"), "supports": empty, "resistances": empty, "atr_pct": div(c("atr"), c("close")) * 100}
    )
    df = apply_regime(levels.add_levels(df))
    return df.select(
        "ticker", "date", "seq", "prob_up", "signal", "side", "confidence_pct", "conviction_pct", "price", "atr", "atr_pct",
        "entry", "stop_loss", c("tp1_raw").alias("tp1"), c("tp2_raw").alias("tp2"),
        F.when(c("entry").isNotNull(), levels.MIN_REWARD_RISK).alias("risk_reward"),
        "position_size_pct", c("status").alias("regime"), "trading_allowed", "volume_ratio",
    )
