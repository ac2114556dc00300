"""Forward test: recorded signals resolved against later bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import clip, div
from barweave.operators import backtest
from barweave.panel import series

c = F.col

RESOLVE_SESSIONS = 5
KEY = ["ticker", "trade_date"]


def record(log: DataFrame) -> DataFrame:
    """The newest record per ticker and day."""
    from barweave.operators.store import current

    return current(log)


def pending(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Signals without an outcome."""
    return signals.join(outcomes.select(*KEY), KEY, "left_anti")


def _windows(bars: DataFrame, sessions: int) -> DataFrame:
    path = F.collect_list(F.struct("high", "low", "close")).over(series().rowsBetween(1, sessions))
    return panel.windowed(bars, [lambda d: d.withColumn("_path", path)], ahead=sessions).select(
        "ticker", c("date").alias("trade_date"), "_path"
    )


def touches(path: Column, side: Column, stop: Column, target: Column) -> tuple[Column, Column]:
    """1-based session of the first stop and target touch, 0 for none."""
    long = side == "long"
    hit_stop = F.transform(path, lambda b: F.when(long, b["low"] <= stop).otherwise(b["high"] >= stop))
    hit_target = F.transform(path, lambda b: F.when(long, b["high"] >= target).otherwise(b["low"] <= target))
    first = lambda arr: F.coalesce(F.array_position(arr, True), F.lit(0))
    return first(hit_stop), first(hit_target)


def resolve(signals: DataFrame, bars: DataFrame, sessions: int = RESOLVE_SESSIONS) -> DataFrame:
    """Next-close return and first touch of stop or first target.

    A stop touched in the same session as the target counts as the stop. A
    signal without a bar on its date, or without a later bar, stays pending.
    """
    joined = signals.join(_windows(bars, sessions), KEY).where(F.size("_path") > 0)
    return with_outcome(joined)


def with_outcome(df: DataFrame) -> DataFrame:
    """Outcome columns from the later bars in ``_path``."""
    sign = F.when(c("side") == "long", 1.0).otherwise(-1.0)
    next_close = F.element_at("_path", 1)["close"]
    ret = (div(next_close, F.when(c("entry") != 0, c("entry"))) - 1) * 100 * sign
    stop_at, target_at = touches(c("_path"), c("side"), c("stop_loss"), c("tp1"))
    levels = (c("entry") != 0) & (c("stop_loss") != 0)
    df = df.withColumns({"next_close": next_close, "next_ret_pct": ret, "_s": stop_at, "_t": target_at, "_lv": F.coalesce(levels, F.lit(False))})
    stopped = c("_lv") & (c("_s") > 0) & ((c("_t") == 0) | (c("_s") <= c("_t")))
    took = c("_lv") & (c("_t") > 0) & ~((c("_s") > 0) & (c("_s") <= c("_t")))
    return df.withColumns(
        {
            "direction_correct": F.coalesce((c("next_ret_pct") > 0).cast("int"), F.lit(0)),
            "hit_sl": stopped.cast("int"),
            "hit_tp1": took.cast("int"),
        }
    ).drop("_path", "_s", "_t", "_lv")


def resolve_pending(signals: DataFrame, outcomes: DataFrame, bars: DataFrame) -> DataFrame:
    return resolve(pending(signals, outcomes), bars)


OUTCOME_COLUMNS = [*KEY, "next_close", "next_ret_pct", "direction_correct", "hit_tp1", "hit_sl"]


def daily_returns(resolved: DataFrame) -> DataFrame:
    """Mean size-weighted return per day."""
    weight = clip(F.coalesce("position_size_pct", F.lit(0.0)) / 100, 0.0, 1.0)
    return resolved.groupBy("trade_date").agg(F.avg(c("next_ret_pct") / 100 * weight).alias("strategy_return"))


def performance(resolved: DataFrame) -> DataFrame:
    """One row of running measures over all resolved signals."""
    r = c("next_ret_pct")
    days = daily_returns(resolved).withColumn("_year", F.year("trade_date"))
    curve = backtest.metrics(days, [], ["trade_date"], "_year")
    gain, loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r <= 0, -r))
    stats = resolved.agg(
        F.count(F.lit(1)).alias("n_resolved"),
        F.avg(c("direction_correct").cast("double")).alias("directional_accuracy"),
        F.avg(F.coalesce((r > 0).cast("double"), F.lit(0.0))).alias("win_rate"),
        F.sum("hit_tp1").alias("hit_tp1"),
        F.sum("hit_sl").alias("hit_sl"),
        F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"),
        F.avg(r).alias("avg_return_pct"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
    )
    packed = curve.select(F.struct(*curve.columns)).scalar()
    return stats.withColumn("_m", packed).select(*stats.columns, "_m.*")


def by_signal(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("signal").agg(F.count("next_ret_pct").alias("n"), F.avg("next_ret_pct").alias("mean_ret_pct"))


def listing(signals: DataFrame, outcomes: DataFrame, limit: int = 100) -> DataFrame:
    """Newest signals with their outcome, if any."""
    joined = signals.join(outcomes.select(*OUTCOME_COLUMNS), KEY, "left")
    return joined.orderBy(c("trade_date").desc(), "ticker").limit(limit)


def split_legacy(legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals and outcomes of a flattened legacy table; flags default to 0."""
    outcome = set(OUTCOME_COLUMNS[2:])
    signals = legacy.select(*[x for x in legacy.columns if x not in outcome | {"resolved_at"}])
    done = legacy.where(c("resolved_at").isNotNull()).select(
        *KEY, "next_close", "next_ret_pct", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("direction_correct", "hit_tp1", "hit_sl")]
    )
    return signals, done


def import_if_empty(target: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` when the target table is empty, else nothing to append."""
    return rows.where(target.limit(1).agg(F.count(F.lit(1))).scalar() == 0)
