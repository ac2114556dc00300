"""Additive explanation of a score, as a long table of contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Readable names of the main features.
LABELS = {
    "rsi": "RSI (14)",
    "macd_norm": "Normalised MACD",
    "macd_diff_norm": "MACD histogram",
    "bb_pct": "Bollinger %B",
    "bb_width": "Bollinger width",
    "stoch_k": "Stochastic %K",
    "williams_r": "Williams %R",
    "cci": "CCI",
    "dist_sma_10": "Distance to SMA10",
    "dist_sma_20": "Distance to SMA20",
    "dist_sma_50": "Distance to SMA50",
    "vol_20d": "Volatility 20d",
    "vol_60d": "Volatility 60d",
    "volume_ratio": "Relative volume",
    "ret_5d": "Return 5d",
    "ret_20d": "Return 20d",
    "momentum_20": "Momentum 20d",
    "atr_pct": "ATR %",
    "adx": "ADX",
}


#: The name of a row's base, the log-odds of a row at the means.
BASE = "(base)"


def contributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float], base: float | None = None) -> DataFrame:
    """Long table (keys, feature, raw, value) with value = coefficient·(x - mean).

    With ``base`` each row also has that as a value of its own, so that its values add up to its log-odds.
    """
    names = list(coefficients)
    own = [] if base is None else [F.struct(F.lit(BASE).alias("feature"), F.lit(None).cast("double").alias("raw"), F.lit(float(base)).alias("value"))]
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                c(n).cast("double").alias("raw"),
                (F.lit(float(coefficients[n])) * (c(n) - F.lit(float(means[n])))).alias("value"),
            )
            for n in names
        ],
        *own,
    )
    return df.select("ticker", "date", F.explode(items).alias("x")).select("ticker", "date", "x.*")


def label(feature: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, feature), F.replace(feature, F.lit("_"), F.lit(" ")))


def top_factors(contribs: DataFrame, n: int = 5, floor: float = 1e-4) -> DataFrame:
    """The strongest contributions per row; a row has one entry per model feature."""
    w = Window.partitionBy("ticker", "date").orderBy(F.abs("value").desc(), "feature")
    ranked = contribs.withColumn("pos", F.row_number().over(w)).where((c("pos") <= n) & (F.abs("value") >= floor))
    return ranked.withColumns({"direction": F.when(c("value") > 0, "buy").otherwise("sell"), "label": label(c("feature"))})


def pressure(contribs: DataFrame, base: float = 0.0) -> DataFrame:
    """Sum of positive and of negative contributions, and the probability they imply."""
    v = c("value")
    agg = contribs.groupBy("ticker", "date").agg(
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("buy_pressure"),
        F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("sell_pressure"),
    )
    agg = agg.withColumn("logodds", c("buy_pressure") + c("sell_pressure") + base)
    return agg.withColumn("prob_up", 1 / (1 + F.exp(-c("logodds"))))


def summary(pressures: DataFrame) -> DataFrame:
    """One sentence per row."""
    text = lambda x: F.floor(x * 1000 + 0.5).cast("long").cast("string")
    verdict = F.when(
        c("buy_pressure") > F.abs("sell_pressure"), "Momentum dominates in favour."
    ).otherwise("Favourable momentum is mixed with overbought or volatility pressure.")
    return pressures.withColumn(
        "summary",
        F.concat(
            F.lit("Bullish factors sum to "), text(c("buy_pressure")), F.lit("e-3 log-odds, bearish ones to "),
            text(c("sell_pressure")), F.lit("e-3; P(up) is about "), F.floor(c("prob_up") * 100 + 0.5).cast("string"),
            F.lit("%. "), verdict,
        ),
    )
