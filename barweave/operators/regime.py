"""Market regime of every bar: normal, caution or suspended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import div, text1
from barweave.operators.features import full, lag, last_rows, layered, pct_change, std, true_range

c = F.col

# Fixed thresholds.
VIX_SUSPEND_LEVEL = 35.0
VIX_SUSPEND_Z = 3.0
VIX_CAUTION_LEVEL = 25.0
VIX_CAUTION_Z = 1.8
GAP_ATR_SUSPEND = 2.5
GAP_ATR_CAUTION = 1.5
RANGE_ATR_CAUTION = 3.0
MIN_HISTORY = 20


def simple_atr():
    """14-bar simple mean of the true range; the first true range is unknown."""
    yield {"_prev": lag("close")}
    yield {"_tr_null": true_range(first_is_null=True)}
    yield {"atr_sma": full(14, F.avg("_tr_null").over(last_rows(14)), c("_tr_null"))}


def range_and_gap():
    """Day range and opening gap in units of ``atr_sma``."""
    yield from simple_atr()
    atr = F.when(c("atr_sma") > 0, c("atr_sma"))
    yield {"range_atr": div(c("high") - c("low"), atr), "gap_atr": div(F.abs(c("open") - c("_prev")), atr)}


def vix_scores(vix: DataFrame) -> DataFrame:
    """Level and z-score over up to 60 known gauge rows (at least 30). Calendar-bounded.

    A row without a close says nothing: the last known level holds.
    """
    vix = vix.where(c("close").isNotNull())
    w = Window.orderBy("date").rowsBetween(-59, 0)
    sd = F.stddev_samp("close").over(w)
    z = F.when((F.count("close").over(w) >= 30) & (sd > 0), div(c("close") - F.avg("close").over(w), sd))
    return vix.select("date", c("close").alias("vix_level"), z.alias("vix_z"))


def by_calendar_day(scores: DataFrame, until: Column) -> DataFrame:
    """Repeat each row for the days until the next one, so an as-of join is an equi join.

    The result has one row per calendar day at most.
    """
    next_date = F.lead("date").over(Window.orderBy("date"))
    last_day = F.coalesce(F.date_sub(next_date, 1), F.greatest(until, c("date")))
    days = scores.withColumn("_last", last_day)
    return days.withColumn("date", F.explode(F.sequence("date", "_last"))).drop("_last")


def join_vix_asof(bars: DataFrame, vix: DataFrame) -> DataFrame:
    """Attach the last gauge row at or before each bar."""
    until = bars.agg(F.max("date")).scalar()
    return bars.join(by_calendar_day(vix_scores(vix), until), "date", "left")


def classify(df: DataFrame) -> DataFrame:
    """Status, size multiplier and tradability from the measures."""
    short = c("seq") < MIN_HISTORY
    gap_stop = c("gap_atr") >= GAP_ATR_SUSPEND
    vix_stop = (c("vix_level") >= VIX_SUSPEND_LEVEL) | (c("vix_z") >= VIX_SUSPEND_Z)
    caution = (
        (c("range_atr") >= RANGE_ATR_CAUTION)
        | (c("gap_atr") >= GAP_ATR_CAUTION)
        | (c("vix_level") >= VIX_CAUTION_LEVEL)
        | (c("vix_z") >= VIX_CAUTION_Z)
    )
    status = (
        F.when(short, "caution").when(gap_stop, "suspended").when(vix_stop, "suspended").when(caution, "caution")
        .otherwise("normal")
    )
    df = df.withColumn("status", status)
    scale = F.when(c("status") == "normal", 1.0).when(c("status") == "caution", 0.5).otherwise(0.0)
    return df.withColumns({"position_scale": scale, "trading_allowed": c("status") != "suspended"})


def add_reasons(df: DataFrame) -> DataFrame:
    """Ordered texts behind the status; a stop ends the list."""
    vix_text = F.concat(text1(c("vix_level")), F.coalesce(F.concat(F.lit(", z="), text1(c("vix_z"))), F.lit("")))
    gap_stop = F.coalesce(c("gap_atr") >= GAP_ATR_SUSPEND, F.lit(False))
    vix_stop = F.coalesce((c("vix_level") >= VIX_SUSPEND_LEVEL) | (c("vix_z") >= VIX_SUSPEND_Z), F.lit(False))
    vix_high = (c("vix_level") >= VIX_CAUTION_LEVEL) | (c("vix_z") >= VIX_CAUTION_Z)
    found = F.array_compact(
        F.array(
            F.when(c("range_atr") >= RANGE_ATR_CAUTION, F.concat(F.lit("day range "), text1(c("range_atr")), F.lit("x ATR"))),
            F.when(gap_stop, F.concat(F.lit("opening gap "), text1(c("gap_atr")), F.lit("x ATR, above the stop level")))
            .when(c("gap_atr") >= GAP_ATR_CAUTION, F.concat(F.lit("opening gap "), text1(c("gap_atr")), F.lit("x ATR"))),
            F.when(~gap_stop & vix_stop, F.concat(F.lit("volatility panic ("), vix_text, F.lit(")")))
            .when(~gap_stop & vix_high, F.concat(F.lit("volatility elevated ("), vix_text, F.lit(")"))),
        )
    )
    reasons = (
        F.when(c("seq") < MIN_HISTORY, F.array(F.lit("short history (<20 bars)")))
        .when(c("status") == "normal", F.array(F.lit("normal conditions")))
        .otherwise(found)
    )
    return df.withColumn("reasons", reasons)


def regimes(bars: DataFrame, vix: DataFrame, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """The regime of every bar."""
    measured = panel.windowed(bars, [layered(range_and_gap)], back=16, rows=rows)
    return classify(join_vix_asof(measured, vix))


def as_of(bars: DataFrame, vix: DataFrame, date: str) -> DataFrame:
    """The regime of each ticker's last bar at or before ``date``."""
    known = bars.where(c("date") <= F.to_date(F.lit(date)))
    return panel.newest(regimes(panel.tail(known, 32), vix))


def vol_terciles(bars: DataFrame, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """Label each bar by the tercile of its 20-bar realised volatility.

    The cut points use the ticker's whole history, so the label is for
    reporting only. ``low`` closes on the right.
    """
    vol = panel.windowed(
        bars,
        [lambda d: d.withColumn("_ret", pct_change("close")), lambda d: d.withColumn("realized_vol", std(20, "_ret"))],
        back=21,
        rows=rows,
    ).drop("_ret")
    cuts = panel.exact_quantiles(vol, ["ticker"], "realized_vol", [1 / 3, 2 / 3], F.floor(c("realized_vol") * 200_000))
    label = (
        F.when(c("realized_vol") <= c("q0"), "low")
        .when(c("realized_vol") <= c("q1"), "mid")
        .when(c("realized_vol") > c("q1"), "high")
    )
    return vol.join(cuts, "ticker", "left").withColumn("vol_regime", label).drop("q0", "q1")
