"""Vector back-test with costs, trade extraction and performance measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import div
from barweave.operators.features import lag

c = F.col

PERIODS_PER_YEAR = 252


@dataclass(frozen=True)
class Costs:
    """Fractions of the traded value, per side."""

    commission: float = 0.0005
    spread: float = 0.0005
    slippage: float = 0.0005

    @property
    def one_side(self) -> float:
        return self.commission + self.spread + self.slippage

    @property
    def round_trip(self) -> float:
        return 2 * self.one_side


def align(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals on the bar calendar; a missing signal is 0."""
    return bars.join(signals, ["ticker", "date"], "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


def add_position(allow_short: bool = False):
    """Yesterday's signal, held today. The first bar is always flat."""
    held = lag("signal")
    position = held * 2 - 1 if allow_short else F.greatest(held, F.lit(0))
    return lambda df: df.withColumn("position", F.coalesce(F.when(held.isNotNull(), position), F.lit(0)).cast("double"))


def add_returns(costs: Costs):
    """Open-to-open return of the position decided two bars ago, less costs.

    Every position change pays a full round trip.
    """

    def step(df: DataFrame) -> DataFrame:
        gross = (div(c("open"), lag("open")) - 1) * F.coalesce(lag("position"), F.lit(0.0))
        traded = F.abs(c("position") - lag("position"))
        df = df.withColumns(
            {
                "gross_return": F.coalesce(gross, F.lit(0.0)),
                "cost": F.coalesce(traded, F.lit(0.0)) * costs.round_trip,
                "_turn": F.coalesce((c("position") != lag("position")).cast("int"), F.lit(1)),
            }
        )
        return df.withColumn("strategy_return", c("gross_return") - c("cost"))

    return step


def portfolio(
    bars: DataFrame,
    costs: Costs = Costs(),
    allow_short: bool = False,
    capital: float = 100_000.0,
    rows: int = panel.SEGMENT_ROWS,
) -> DataFrame:
    """Position, returns, equity and trade block of every bar.

    ``bars`` carries a 0/1 ``signal``.
    """
    df = panel.windowed(bars, [add_position(allow_short), add_returns(costs)], back=3, rows=rows)
    df = df.withColumn("_growth", c("strategy_return") + 1)
    df = panel.running(df, ["ticker"], ["seq"], "seg", equity=("product", "_growth"), block=("sum", "_turn"))
    return df.withColumn("equity", c("equity") * capital).drop("_growth", "_turn")


def trades(curve: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per stretch of constant non-zero position."""
    blocks = curve.where(c("position") != 0).groupBy("ticker", "block").agg(
        F.first("position").alias("_p"),
        F.min("date").alias("entry_date"),
        F.max("date").alias("exit_date"),
        (F.min_by("open", "seq") * (1 + costs.one_side)).alias("entry_price"),
        (F.max_by("close", "seq") * (1 - costs.one_side)).alias("exit_price"),
        F.count(F.lit(1)).alias("days_held"),
    )
    return blocks.withColumns(
        {
            "direction": F.when(c("_p") > 0, "long").otherwise("short"),
            "trade_return": (div(c("exit_price"), c("entry_price")) - 1) * c("_p"),
        }
    ).drop("_p")


def drawdowns(df: DataFrame, keys: list[str], order: list, bucket: str, value: str = "strategy_return") -> DataFrame:
    """Growth curve and its distance from the running peak.

    The peak starts at the first point of the curve, not at 1.
    """
    grown = df.withColumn("_growth", c(value) + 1)
    curve = panel.compounded(grown, keys, order, bucket, "_growth")
    return curve.withColumn("drawdown", div(c("curve"), c("peak")) - 1).drop("_growth")


def metrics(
    df: DataFrame,
    keys: list[str],
    order: list = ("seq",),
    bucket: str = "seg",
    value: str = "strategy_return",
    risk_free_rate: float = 0.0,
) -> DataFrame:
    """Return, risk and drawdown measures per key."""
    df = df.where(c(value).isNotNull())
    curve = drawdowns(df, list(keys), list(order), bucket, value)
    excess = c(value) - risk_free_rate / PERIODS_PER_YEAR
    year = F.sqrt(F.lit(float(PERIODS_PER_YEAR)))
    agg = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.product(c(value) + 1) - 1).alias("total_return"),
        F.stddev_samp(value).alias("_sd"),
        F.avg(excess).alias("_mean"),
        F.stddev_samp(F.when(excess < 0, excess)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
    )
    down = F.coalesce(c("_down"), F.lit(0.0)) * year
    agg = agg.withColumn("annual_return", F.pow(c("total_return") + 1, PERIODS_PER_YEAR / c("n_days")) - 1)
    return agg.select(
        *keys,
        "n_days",
        "total_return",
        "annual_return",
        (c("_sd") * year).alias("annual_vol"),
        F.when(c("_sd") > 0, c("_mean") / c("_sd") * year).otherwise(0.0).alias("sharpe_ratio"),
        F.when(down > 0, c("_mean") / down * year).otherwise(0.0).alias("sortino_ratio"),
        "max_drawdown",
        F.when(c("max_drawdown") < 0, c("annual_return") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar_ratio"),
    )


def _ratio(gain: Column, loss: Column) -> Column:
    """gain/loss; null (unbounded) without losses, 0 without gains either."""
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(None).cast("double")).otherwise(0.0)


def loss_streaks(df: DataFrame, keys: list[str], order: list, bucket: str, value: str = "trade_return") -> DataFrame:
    """Longest run of trades with no gain, in trade order."""
    marked = df.withColumn("_win", (c(value) > 0).cast("int"))
    runs = panel.running(marked, keys, order, bucket, _run=("sum", "_win"))
    lengths = runs.groupBy(*keys, "_run").agg(F.count_if(c(value) <= 0).alias("_len"))
    return lengths.groupBy(*keys).agg(F.max("_len").alias("max_consecutive_losses"))


def trade_metrics(df: DataFrame, keys: list[str] = ("ticker",), value: str = "trade_return") -> DataFrame:
    keys = list(keys)
    r = c(value)
    df = df.where(r.isNotNull()).withColumn("_year", F.year("entry_date"))
    gain, loss = F.when(r > 0, r), F.when(r <= 0, r)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("_gain"),
        F.coalesce(-F.sum(loss), F.lit(0.0)).alias("_loss"),
        F.coalesce(F.avg(gain), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.avg(r).alias("expectancy"),
    )
    agg = agg.withColumns(
        {"profit_factor": _ratio(c("_gain"), c("_loss")), "win_loss_ratio": _ratio(c("avg_win"), F.abs("avg_loss"))}
    ).drop("_gain", "_loss")
    streaks = loss_streaks(df, keys, ["entry_date"], "_year", value)
    return agg.join(streaks, keys) if keys else agg.withColumn("max_consecutive_losses", streaks.scalar())


def regime_metrics(curve: DataFrame, regimes: DataFrame) -> DataFrame:
    """``metrics`` per volatility regime of each ticker; unlabelled days drop out."""
    labelled = curve.join(regimes.select("ticker", "date", "vol_regime"), ["ticker", "date"])
    return metrics(labelled.where(c("vol_regime").isNotNull()), ["ticker", "vol_regime"])


def walk_forward_signals(oof: DataFrame, folds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """0/1 signals on the out-of-sample dates only."""
    tested = folds.where(c("role") == "test").select("date").distinct()
    fired = (c("prob_up") >= threshold).cast("int").alias("signal")
    return oof.join(tested, "date", "left_semi").select("ticker", "date", fired)


def report(portfolio_metrics: DataFrame, trade_stats: DataFrame, by_regime: DataFrame, costs: Costs) -> DataFrame:
    """Long table (ticker, section, metric, value) behind the written report."""

    def long(df: DataFrame, section: Column, skip: list[str]) -> DataFrame:
        names = [x for x in df.columns if x not in skip]
        doubles = df.select(*skip, *[c(x).cast("double").alias(x) for x in names])
        return doubles.unpivot(skip, names, "metric", "value").select("ticker", section.alias("section"), "metric", "value")

    spec = [("commission", costs.commission), ("spread", costs.spread), ("slippage", costs.slippage), ("round_trip", costs.round_trip)]
    params = portfolio_metrics.select("ticker", *[F.lit(v).alias(k) for k, v in spec])
    return (
        long(params, F.lit("costs"), ["ticker"])
        .unionByName(long(portfolio_metrics, F.lit("portfolio"), ["ticker"]))
        .unionByName(long(trade_stats, F.lit("trades"), ["ticker"]))
        .unionByName(long(by_regime, F.concat(F.lit("regime "), "vol_regime"), ["ticker", "vol_regime"]))
    )


def markdown(rows: list, title: str = "Back-test report") -> str:
    """Text of one ticker's report table (a few dozen collected rows)."""
    lines = [f"# {title}", ""]
    section = None
    for r in sorted(rows, key=lambda r: (r["section"], r["metric"])):
        if r["section"] != section:
            section = r["section"]
            lines += ["", f"## {section}", "", "| metric | value |", "|---|---|"]
        lines.append(f"| {r['metric']} | {'inf' if r['value'] is None else format(r['value'], '.4f')} |")
    return "\n".join(lines)
