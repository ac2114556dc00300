"""Indicator columns over a bar panel.

An indicator is a generator of column layers: each ``yield`` is a dict of new
columns, and later layers may use earlier ones. ``layered`` adds the first
layers of all chosen indicators together, then the second ones, and so on, so
any set of indicators needs only a few window passes over one sort. Names that
start with an underscore are intermediate and dropped at the end. Undefined
values are null, never NaN; bars themselves hold no nulls, so a frame over
bar columns is complete once ``seq`` reaches its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import div
from barweave.functions.recurrence import check_window, ema, factors, longest_window, warmup_rows, wilder
from barweave.panel import full, last_rows, series

c = F.col


def lag(column: str | Column, n: int = 1) -> Column:
    return F.lag(column, n).over(series())


def pct_change(column: str, n: int = 1) -> Column:
    return div(c(column), lag(column, n)) - 1


def ready(n: int, value: Column) -> Column:
    """``value`` from row n on."""
    return F.when(c("seq") >= n, value)


def bar_mean(n: int, column: str) -> Column:
    """Mean of a bar column over n rows."""
    return ready(n, F.avg(column).over(last_rows(n)))


def mean(n: int, column: str) -> Column:
    return full(n, F.avg(column).over(last_rows(n)), c(column))


def std(n: int, column: str) -> Column:
    return full(n, F.stddev_samp(column).over(last_rows(n)), c(column))


def returns():
    yield {f"ret_{n}d": pct_change("close", n) for n in (1, 3, 5, 10, 20)}


def _ret():
    return {"ret_1d": pct_change("close")}


def volatility():
    yield _ret()
    yield {f"vol_{n}d": std(n, "ret_1d") for n in (5, 10, 20, 60)}


def sma():
    yield {f"sma_{n}": bar_mean(n, "close") for n in (10, 20, 50, 200)}


def emas():
    yield {f"ema_{n}": ema(c("close"), n) for n in (12, 26)}


def dist_sma():
    yield {f"sma_{n}": bar_mean(n, "close") for n in (10, 20, 50)}
    yield {f"dist_sma_{n}": div(c("close") - c(f"sma_{n}"), c(f"sma_{n}")) for n in (10, 20, 50)}


def macd():
    yield {f"ema_{n}": ema(c("close"), n) for n in (12, 26)}
    yield {"macd": ready(26, c("ema_12") - c("ema_26"))}
    start = F.greatest(F.lit(26), c("_first"))
    yield {"macd_signal": ready(34, ema(c("macd"), 9, start)), "macd_norm": div(c("macd"), c("close"))}
    yield {"macd_diff": c("macd") - c("macd_signal"), "macd_diff_norm": div(c("macd") - c("macd_signal"), c("close"))}


def bollinger():
    yield {"bb_mid": bar_mean(20, "close"), "_bb_std": F.stddev_pop("close").over(last_rows(20))}
    yield {"bb_high": c("bb_mid") + 2 * c("_bb_std"), "bb_low": c("bb_mid") - 2 * c("_bb_std")}
    yield {
        "bb_width": div(c("bb_high") - c("bb_low"), c("bb_mid")),
        "bb_pct": div(c("close") - c("bb_low"), c("bb_high") - c("bb_low")),
    }


def true_range(first_is_null: bool) -> Column:
    """Largest of high-low and the gaps to the previous close (``_prev``)."""
    spread = F.greatest(c("high") - c("low"), F.abs(c("high") - c("_prev")), F.abs(c("low") - c("_prev")))
    return F.when(c("_prev").isNotNull(), spread) if first_is_null else spread


def _prev():
    return {"_prev": lag("close")}


def atr():
    yield _prev()
    yield {"_tr": true_range(first_is_null=False)}
    yield {"_tr_seed": F.when(c("_first") == 1, F.avg("_tr").over(last_rows(14))).otherwise(c("_tr"))}
    yield {"atr": wilder(c("_tr"), 14, F.greatest(F.lit(14), c("_first")), c("_tr_seed"))}
    yield {"atr_pct": div(c("atr"), c("close"))}


def adx():
    yield {**_prev(), "_up": c("high") - lag("high"), "_down": lag("low") - c("low")}
    up, down = c("_up"), c("_down")
    yield {
        "_dm_tr": true_range(first_is_null=True),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    }
    parts = ("_dm_tr", "_pdm", "_mdm")
    yield {
        f"{x}_seed": F.when(c("_first") == 1, F.avg(x).over(last_rows(14))).otherwise(F.coalesce(c(x), F.lit(0.0)))
        for x in parts
    }
    start = F.greatest(F.lit(15), c("_first"))
    yield {f"{x}_avg": wilder(c(x), 14, start, c(f"{x}_seed")) for x in parts}
    tr, p, m = c("_dm_tr_avg"), c("_pdm_avg"), c("_mdm_avg")
    yield {"_dx": F.when(tr.isNotNull(), F.coalesce(div(F.abs(p - m), p + m), F.lit(0.0)) * 100)}
    yield {"_dx_seed": F.when(c("_first") == 1, F.avg("_dx").over(last_rows(14))).otherwise(c("_dx"))}
    yield {"adx": wilder(c("_dx"), 14, F.greatest(F.lit(28), c("_first")), c("_dx_seed"))}


def _high_low(n: int) -> dict:
    return {
        f"_hh{n}": ready(n, F.max("high").over(last_rows(n))),
        f"_ll{n}": ready(n, F.min("low").over(last_rows(n))),
    }


def stochastic():
    yield _high_low(14)
    yield {"stoch_k": div(c("close") - c("_ll14"), c("_hh14") - c("_ll14")) * 100}
    yield {"stoch_d": mean(3, "stoch_k")}


def williams_r():
    yield _high_low(14)
    yield {"williams_r": div(c("_hh14") - c("close"), c("_hh14") - c("_ll14")) * -100}


def cci():
    tp = (c("high") + c("low") + c("close")) / 3
    yield {"_tp": tp, "_tp_mean": ready(20, F.avg(tp).over(last_rows(20))), "_tps": F.collect_list(tp).over(last_rows(20))}
    deviations = F.transform("_tps", lambda x: F.abs(x - c("_tp_mean")))
    yield {"_mad": F.aggregate(deviations, F.lit(0.0), lambda acc, x: acc + x) / 20}
    yield {"cci": div(c("_tp") - c("_tp_mean"), c("_mad") * 0.015)}


def rsi():
    yield _prev()
    move = c("close") - c("_prev")
    yield {"_g": F.when(move > 0, move).otherwise(0.0), "_l": F.when(move < 0, -move).otherwise(0.0)}
    yield {"_gain": wilder(c("_g"), 14, c("_first"), c("_g")), "_loss": wilder(c("_l"), 14, c("_first"), c("_l"))}
    value = F.when(c("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + div(c("_gain"), c("_loss"))))
    yield {"rsi": ready(14, value)}


def obv_ratio():
    """On-balance volume against 20-row volume; ``obv`` comes from ``with_obv``."""
    yield {"_vol_sum_20": ready(20, F.sum("volume").over(last_rows(20)))}
    yield {"obv_ratio_20d": div(c("obv"), c("_vol_sum_20"))}


def vwap():
    tpv = (c("high") + c("low") + c("close")) / 3 * c("volume")
    yield {"vwap": ready(14, div(F.sum(tpv).over(last_rows(14)), F.sum("volume").over(last_rows(14))))}
    yield {"dist_vwap": div(c("close") - c("vwap"), c("vwap"))}


def volume():
    yield {"volume_sma_20": bar_mean(20, "volume"), "volume_roc": pct_change("volume", 5)}
    yield {"volume_ratio": div(c("volume"), c("volume_sma_20"))}


def momentum():
    yield {f"momentum_{n}": pct_change("close", n) for n in (5, 10, 20)}


def lag_returns():
    yield _ret()
    yield {f"lag_ret_{n}": lag("ret_1d", n) for n in (1, 2, 3, 5, 10)}


def range20():
    yield {"high_20d": ready(20, F.max("high").over(last_rows(20))), "low_20d": ready(20, F.min("low").over(last_rows(20)))}
    yield {"range_20d": div(c("high_20d") - c("low_20d"), c("close"))}


def median20():
    yield {"_closes": F.array_sort(F.collect_list("close").over(last_rows(20)))}
    yield {"median_20d": ready(20, (F.get("_closes", F.lit(9)) + F.get("_closes", F.lit(10))) / 2)}


def candle():
    body = F.abs(c("close") - c("open"))
    yield {
        "body": body,
        "upper_shadow": c("high") - F.greatest("close", "open"),
        "lower_shadow": F.least("close", "open") - c("low"),
        "total_range": c("high") - c("low"),
        "body_pct": div(body, c("high") - c("low")),
    }


def calendar():
    day = F.dayofmonth("date")
    yield {
        "day_of_week": F.weekday("date"),
        "month": F.month("date"),
        "quarter": F.quarter("date"),
        "day_of_month": day,
        "is_month_end": (day > 25).cast("int"),
        "is_month_start": (day <= 5).cast("int"),
    }


def market_corr():
    """20-row correlation of the own return with ``market_ret_1d``."""
    yield _ret()
    both = c("ret_1d").isNotNull() & c("market_ret_1d").isNotNull()
    yield {"_own": F.when(both, c("ret_1d")), "_mkt": F.when(both, c("market_ret_1d"))}
    w = last_rows(20)
    # corr() raises on a flat frame, so divide the covariance null-safely
    corr = div(F.covar_pop("_own", "_mkt").over(w), F.stddev_pop("_own").over(w) * F.stddev_pop("_mkt").over(w))
    yield {"market_corr_20d": full(20, corr, c("_own"))}


def layered(*indicators):
    """A step that adds the columns of ``indicators``, layer by layer."""

    def step(df: DataFrame) -> DataFrame:
        kept = [x for x in df.columns]
        running = [i() for i in indicators]
        while running:
            layer, alive = {}, []
            for gen in running:
                columns = next(gen, None)
                if columns is not None:
                    layer.update(columns)
                    alive.append(gen)
            if layer:
                df = df.withColumns({k: v for k, v in layer.items() if k not in df.columns})
            running = alive
        return df.drop(*[x for x in df.columns if x.startswith("_") and x not in kept])

    return step


def with_obv(bars: DataFrame, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """On-balance volume: volume counts as negative when the close falls.

    The running sum covers the whole history, so it is taken in two levels.
    """
    flow = F.when(c("close") < lag("close"), -c("volume")).otherwise(c("volume"))
    signed = panel.windowed(bars, [lambda d: d.withColumn("_flow", flow)], back=1, rows=rows)
    return panel.running(signed, ["ticker"], ["seq"], "seg", obv=("sum", "_flow")).drop("_flow")


# --- market context -------------------------------------------------------
# The index and the volatility gauge have at most one row per calendar day, so
# one unpartitioned window over them stays small whatever the panel size.


def calendar_rows(n: int) -> Window:
    return Window.orderBy("date").rowsBetween(-(n - 1), 0)


def calendar_full(n: int, agg, column: str) -> Column:
    """Aggregate over the last n rows of a calendar series, null until n values exist."""
    return F.when(F.count(column).over(calendar_rows(n)) == n, agg(column).over(calendar_rows(n)))


def calendar_change(n: int) -> Column:
    return div(c("close"), F.lag("close", n).over(Window.orderBy("date"))) - 1


def market_context(market: DataFrame) -> DataFrame:
    """Index return, trend distance and volatility on the index's calendar."""
    df = market.select(
        "date", "close", calendar_change(1).alias("market_ret_1d"), calendar_change(5).alias("market_ret_5d"),
        calendar_full(20, F.avg, "close").alias("_sma"),
    )
    return df.select(
        "date",
        "market_ret_1d",
        "market_ret_5d",
        div(c("close") - c("_sma"), c("_sma")).alias("market_dist_sma_20"),
        calendar_full(20, F.stddev_samp, "market_ret_1d").alias("market_vol_20d"),
    )


def vix_context(vix: DataFrame) -> DataFrame:
    """Volatility gauge level, 60-row z-score and 5-row change."""
    level, spread = calendar_full(60, F.avg, "close"), calendar_full(60, F.stddev_samp, "close")
    return vix.select(
        "date",
        c("close").alias("vix_level"),
        div(c("close") - level, spread).alias("vix_zscore"),
        calendar_change(5).alias("vix_change_5d"),
    )


def join_context(df: DataFrame, market: DataFrame | None = None, vix: DataFrame | None = None) -> DataFrame:
    """Attach context by exact session date (left join)."""
    if market is not None:
        df = df.join(market_context(market), "date", "left")
    if vix is not None:
        df = df.join(vix_context(vix), "date", "left")
    return df


ALL = [
    returns, volatility, sma, emas, dist_sma, macd, bollinger, atr, adx, stochastic, williams_r, cci, rsi, obv_ratio, vwap,
    volume, momentum, lag_returns, range20, median20, candle, calendar,
]

# The scale-free inputs of the ensemble and of the small model.
MODEL_FEATURES = [
    "ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d",
    "vol_5d", "vol_10d", "vol_20d", "vol_60d",
    "dist_sma_10", "dist_sma_20", "dist_sma_50",
    "macd_norm", "macd_diff_norm", "bb_width", "bb_pct",
    "rsi", "stoch_k", "stoch_d", "williams_r", "cci",
    "momentum_5", "momentum_10", "momentum_20", "adx", "atr_pct",
    "volume_ratio", "volume_roc", "obv_ratio_20d", "dist_vwap",
    "lag_ret_1", "lag_ret_2", "lag_ret_3", "lag_ret_5", "lag_ret_10",
    "range_20d", "body_pct",
    "day_of_week", "month", "quarter", "day_of_month", "is_month_end", "is_month_start",
    "market_ret_1d", "market_ret_5d", "market_dist_sma_20", "market_vol_20d", "market_corr_20d",
    "vix_level", "vix_zscore", "vix_change_5d",
]
PANELS = ["rsi", "macd", "macd_signal"]
BASIC_FEATURES = [
    "ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "dist_sma_10", "dist_sma_20",
    "rsi", "volume_ratio", "day_of_week", "month",
]


#: The steepest decay factor of the built-in averages (span 9).
STEEPEST = 2 / 10


def decay_factors(indicators: list) -> set[float]:
    """The decay factors of the exponential averages in these indicators, own ones included."""
    with factors() as found:
        for indicator in indicators:
            for _ in indicator():
                pass
    return found


def compute(bars: DataFrame, indicators: list, rows: int = panel.SEGMENT_ROWS, slowest: float | None = None, steepest: float | None = None) -> DataFrame:
    """Add the columns of ``indicators`` to sequenced bars.

    The slowest decay factor sets how many rows are replayed before a segment, the steepest
    one how long a segment may be. The factors are those that the indicators use; ``slowest`` and ``steepest`` can
    only widen them. More ``rows`` than the steepest one (by default that of the built-in averages) allows are refused.
    """
    check_window(rows + panel.WARMUP_ROWS, steepest or STEEPEST)
    used = [x for x in (slowest, steepest, *decay_factors(indicators)) if x is not None]
    back = panel.WARMUP_ROWS
    if used:
        back = max(back, warmup_rows(min(used)))
        rows = max(back, min(rows, longest_window(max(used)) - back))
        check_window(rows + back, max(used))
    if obv_ratio in indicators:
        bars = with_obv(bars, rows)
    return panel.windowed(bars, [layered(*indicators)], back=back, rows=rows)


def compute_all(
    bars: DataFrame,
    market: DataFrame | None = None,
    vix: DataFrame | None = None,
    rows: int = panel.SEGMENT_ROWS,
) -> DataFrame:
    """Every indicator; context columns only when the context is given. Segments have ``rows`` rows at most, and no more than averages allow."""
    rows = min(rows, longest_window(STEEPEST) - panel.WARMUP_ROWS)
    indicators = ALL if market is None else [*ALL, market_corr]
    return compute(join_context(bars, market, vix), indicators, rows)


def chart_overlays(bars: DataFrame, features: DataFrame | None = None, days: int = 260) -> DataFrame:
    """Moving averages and bands over the last ``days`` bars of each ticker, and the panels below them.

    The overlays start at the first charted bar, and are only drawn when more
    than 210 bars are charted. ``days`` bounds the rows per ticker. The panels (rsi, macd, macd_signal) come from
    ``features``, so they know the whole history; without it there are none.
    """
    if days > panel.SEGMENT_ROWS:
        raise ValueError("chart at most one segment of bars")
    lengths = bars.groupBy("ticker").agg(F.max("seq").alias("_n"))
    tail = bars.join(lengths, "ticker").where(c("seq") > c("_n") - days)
    first = F.greatest(F.lit(1), c("_n") - days + 1)
    tail = tail.withColumns({"_first": first, "seg": F.lit(0)})
    enough = F.least(c("_n"), F.lit(days)) > 210
    sma, dev = mean(20, "close"), std(20, "close")
    drawn = tail.select(
        "ticker", "date", "open", "high", "low", "close", "volume",
        *[F.when(enough, ema(c("close"), n)).alias(f"ema{n}") for n in (20, 50, 200)],
        F.when(enough, sma + 2 * dev).alias("bb_upper"),
        F.when(enough, sma - 2 * dev).alias("bb_lower"),
    )
    return drawn if features is None else drawn.join(features.select("ticker", "date", *PANELS), ["ticker", "date"], "left")
