"""Decisions, horizons and classification measures from probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.exprs import clip, div, half_up

c = F.col

DEFAULT_THRESHOLD = 0.60
BASIC_THRESHOLD = 0.6
THRESHOLDS = [0.5, 0.525, 0.55, 0.575, 0.6, 0.625, 0.65, 0.675, 0.7, 0.725, 0.75, 0.775, 0.8]
MIN_SIGNALS = 30


# --- decisions -------------------------------------------------------------------


def add_decision(df: DataFrame, threshold: Column) -> DataFrame:
    """buy, sell or none, with the confidence of the decision."""
    up, down = c("prob_up"), 1 - c("prob_up")
    decision = F.when(up >= threshold, "buy").when(down >= threshold, "sell").otherwise("none")
    confidence = F.when(up >= threshold, up).when(down >= threshold, down).otherwise(F.greatest(up, down))
    return df.withColumns({"decision": decision, "confidence": confidence})


def message(threshold: Column) -> Column:
    """Tiered text for ``decision`` and ``confidence``."""
    pct = lambda x: F.concat(half_up(x * 100, 2).cast("string"), F.lit("%"))
    conf = pct(c("confidence"))
    return (
        F.when(c("decision") == "none", F.concat(F.lit("discarded: confidence "), conf, F.lit(" below threshold "), pct(threshold)))
        .when(c("confidence") >= 0.75, F.concat(F.lit("high confidence ("), conf, F.lit(")")))
        .when(c("confidence") >= 0.60, F.concat(F.lit("moderate confidence ("), conf, F.lit(")")))
        .otherwise(F.concat(F.lit("low confidence ("), conf, F.lit("), use with care")))
    )


def recommend(prob_up: Column) -> Column:
    """Basic rule: strictly above 0.6 on either side."""
    return F.when(prob_up > BASIC_THRESHOLD, "buy").when(1 - prob_up > BASIC_THRESHOLD, "sell").otherwise("hold")


def default_threshold(explicit: Column, calibrated: Column) -> Column:
    return F.coalesce(explicit, calibrated, F.lit(DEFAULT_THRESHOLD))


def price_state(bars: DataFrame) -> DataFrame:
    """Per ticker: last close, its 1-bar volatility over all history, 5- and 20-bar momentum."""
    from barweave import panel
    from barweave.operators.features import lag, pct_change

    stepped = panel.windowed(
        bars,
        [lambda d: d.withColumns({"_ret": pct_change("close"), "_c5": lag("close", 5), "_c20": lag("close", 20)})],
        back=20,
    )
    agg = stepped.groupBy("ticker").agg(
        F.stddev_samp("_ret").alias("daily_vol"),
        F.max_by(F.struct("date", "close", "_c5", "_c20", "prob_up"), "date").alias("_l"),
    )
    close = c("_l.close")
    return agg.select(
        "ticker", c("_l.date").alias("date"), c("_l.prob_up").alias("prob_up"), close.alias("price"), "daily_vol",
        F.coalesce(div(close, c("_l._c5")) - 1, F.lit(0.0)).alias("mom_5"),
        F.coalesce(div(close, c("_l._c20")) - 1, F.lit(0.0)).alias("mom_20"),
    )


def add_horizons(df: DataFrame) -> DataFrame:
    """Expected moves over 1, 5 and 20 bars with their target prices."""
    sign = F.when(c("decision") == "buy", 1.0).otherwise(-1.0)
    m1 = sign * c("daily_vol") * c("confidence") * 1.5
    m5 = F.when(c("mom_5") * sign > 0, sign * F.abs("mom_5") * c("confidence") * 1.2).otherwise(m1 * 3)
    m20 = F.when(c("mom_20") * sign > 0, sign * F.abs("mom_20") * c("confidence") * 1.1).otherwise(m5 * 2)
    df = df.withColumns({"move_1": clip(m1, -0.05, 0.05), "move_5": clip(m5, -0.12, 0.12), "move_20": clip(m20, -0.25, 0.25)})
    return df.withColumns({f"target_{n}": c("price") * (c(f"move_{n}") + 1) for n in (1, 5, 20)})


def holding() -> Column:
    """Holding text from the confidence and the rounded move sizes."""
    m5, m20 = (half_up(F.abs(f"move_{n}") * 100, 2) for n in (5, 20))
    conf = c("confidence")
    high = F.when(m20 >= 8, "15-20 days (long swing)").when(m5 >= 4, "5-10 days (swing)").otherwise("1-3 days (day trading)")
    mid = F.when(m5 >= 3, "3-7 days (moderate swing)").otherwise("1-2 days (day trading)")
    return F.when(conf >= 0.75, high).when(conf >= 0.60, mid).otherwise("intraday or 1 day at most")


def add_stop_take(df: DataFrame) -> DataFrame:
    """Stop two ATRs away (2 % of the price without ATR), take at the 5-bar target."""
    sign = F.when(c("decision") == "buy", -1.0).when(c("decision") == "sell", 1.0)
    atr = F.coalesce("atr", c("price") * 0.02)
    df = df.withColumns(
        {"stop_loss": c("price") + sign * 2.0 * atr, "take_profit": F.when(sign.isNotNull(), half_up(c("target_5"), 2))}
    )
    return df.withColumn("reward_risk", div(F.abs(c("take_profit") - c("price")), F.abs(c("price") - c("stop_loss"))))


def decision_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


# --- classification measures -------------------------------------------------------


def _confusion(df: DataFrame) -> list[Column]:
    hit = lambda p, y: F.count_if((c("prediction") == p) & (c("target") == y))
    return [hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn")]


def _zero(a: Column, b: Column) -> Column:
    return F.coalesce(div(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 and the majority share."""
    k = df.groupBy(*keys).agg(*_confusion(df))
    n = c("tp") + c("fp") + c("fn") + c("tn")
    return k.select(
        *keys,
        n.alias("n"),
        _zero(c("tp") + c("tn"), n).alias("accuracy"),
        _zero(c("tp"), c("tp") + c("fp")).alias("precision"),
        _zero(c("tp"), c("tp") + c("fn")).alias("recall"),
        _zero(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        _zero(F.greatest(c("tp") + c("fn"), c("fp") + c("tn")), n).alias("baseline"),
    )


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    k = df.agg(*_confusion(df))

    def row(label, hit, wrong, missed):
        return F.struct(
            F.lit(label).alias("label"),
            _zero(hit, hit + wrong).alias("precision"),
            _zero(hit, hit + missed).alias("recall"),
            _zero(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    rows = F.array(row(0, c("tn"), c("fn"), c("fp")), row(1, c("tp"), c("fp"), c("fn")))
    return k.select(F.explode(rows).alias("r")).select("r.*")


def weighted_metrics(df: DataFrame) -> DataFrame:
    """Measures averaged over the classes by support."""
    w = lambda x: (F.sum(c(x) * c("support")) / F.sum("support")).alias(x)
    # the share of right predictions is the recall averaged by support
    return class_report(df).agg(w("precision"), w("recall"), w("f1")).withColumn("accuracy", c("recall"))


def member_scores(df: DataFrame) -> DataFrame:
    """Accuracy of each member, averaged over its folds."""
    per_fold = df.groupBy("model", "fold").agg(F.avg((c("prediction") == c("target")).cast("double")).alias("accuracy"))
    return per_fold.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n_folds"))


def simple_backtest(df: DataFrame) -> DataFrame:
    """Sum, unscaled Sharpe and share of gains of next-bar return times prediction."""
    r = c("target_return") * c("prediction")
    return df.groupBy("ticker").agg(
        F.sum(r).alias("total_return"),
        F.coalesce(F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r)), F.lit(0.0)).alias("sharpe_ratio"),
        F.avg(F.coalesce((r > 0).cast("double"), F.lit(0.0))).alias("win_rate"),
    )


# --- probability diagnostics ---------------------------------------------------------


def brier(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.pow(c(x) - c("target"), 2)).alias(f"brier_{x}") for x in columns])


def threshold_table(df: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Signals, rate and precision at each threshold, from one pass over the rows."""
    at = lambda t: c("prob_up") >= F.lit(float(t))
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(at(t)).alias(f"s{i}") for i, t in enumerate(thresholds)],
        *[F.avg(F.when(at(t), c("target").cast("double"))).alias(f"p{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), c(f"s{i}").alias("signals"), c(f"p{i}").alias("precision"))
            for i, t in enumerate(thresholds)
        ]
    )
    out = counts.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    return out.withColumn("signal_rate", c("signals") / c("n"))


def select_threshold(table: DataFrame, min_signals: int = MIN_SIGNALS) -> DataFrame:
    """Most precise threshold with enough signals, then the same without the minimum, then 0.50.

    Among equals the lowest threshold is kept.
    """
    rank = F.struct("precision", "signals", (-c("threshold")).alias("low"))
    best = lambda cond: F.max_by("threshold", F.when(cond, rank))
    known = c("precision").isNotNull()
    return table.agg(F.coalesce(best(known & (c("signals") >= min_signals)), best(known), F.lit(0.50)).alias("threshold"))


def prob_bands(df: DataFrame) -> DataFrame:
    """Five probability bands; the two lowest count falls as hits."""
    p = c("prob_up")
    band = (
        F.when(p <= 0.35, "<=35%").when(p <= 0.45, "35-45%").when(p <= 0.55, "45-55%").when(p <= 0.65, "55-65%").otherwise(">=65%")
    )
    hit = F.when(p <= 0.45, 1 - c("target")).otherwise(c("target")).cast("double")
    bands = df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    return bands.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy()))  # five rows


def confidence_matrix(df: DataFrame) -> DataFrame:
    """Rows and accuracy by distance from one half, for longs and mirrored shorts.

    The long and the short bands share p = 0.5.
    """
    edges = [(0.50, 0.55), (0.55, 0.60), (0.60, 0.65), (0.65, 0.70), (0.70, 1.01)]
    p = c("prob_up")
    spots = []
    for lo, hi in edges:
        name = F.lit(f"{lo:.2f}-{hi:.2f}")
        one = lambda side: F.struct(name.alias("band"), F.lit(side).alias("side"))  # noqa: E731,B023
        spots.append(F.when((p >= lo) & (p < hi), one("long")))
        spots.append(F.when((p <= F.lit(1.0) - lo) & (p > F.lit(1.0) - hi), one("short")))
    rows = df.withColumn("b", F.explode(F.array_compact(F.array(*spots))))
    hit = F.when(c("b.side") == "long", c("target")).otherwise(1 - c("target")).cast("double")
    return rows.groupBy(c("b.band").alias("band"), c("b.side").alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")
    )


def oof_markers(df: DataFrame) -> DataFrame:
    """Chart markers: announced direction and whether it was right."""
    up = c("prob_up") >= 0.5
    return df.select(
        "ticker", "date", "prob_up", F.when(up, "BUY").otherwise("SELL").alias("signal"),
        c("target").alias("actual_up"), (up == (c("target") == 1)).cast("int").alias("correct"),
    )


def oof_range(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n"),
        F.avg(((c("prob_up") >= 0.5).cast("int") == c("target")).cast("double")).alias("overall_accuracy"),
    )
