"""Queries over the vector back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave import panel
from barweave.operators import backtest as bt
from barweave.operators import splits
from barweave.plans.features import _PANEL
from barweave.plans.registry import query
from barweave.plans.sqlparts import W, cols, ctes

c = F.col

_PF = {
    "sig": "SELECT *, CASE WHEN prob_up >= 0.5::DOUBLE THEN 1 ELSE 0 END AS signal FROM bars",
    "pos": f"SELECT *, CAST(coalesce(lag(signal) OVER ({W}), 0) AS DOUBLE) AS position FROM sig",
    "pf0": f"""SELECT *, coalesce((open / lag(open) OVER ({W}) - 1) * coalesce(lag(position) OVER ({W}), 0), 0) AS gross_return,
    coalesce(abs(position - lag(position) OVER ({W})), 0) * 0.003::DOUBLE AS cost,
    CASE WHEN position = lag(position) OVER ({W}) THEN 0 ELSE 1 END AS turn FROM pos""",
    "pf1": "SELECT *, gross_return - cost AS strategy_return FROM pf0",
    "pf": f"SELECT *, product(1 + strategy_return) OVER ({W}) AS equity, CAST(sum(turn) OVER ({W}) AS BIGINT) AS block FROM pf1",
}
_TR = {
    **_PF,
    "tr1": """SELECT ticker, block, any_value(position) AS p, min(date) AS entry_date, max(date) AS exit_date, arg_min(open, date) * 1.0015::DOUBLE AS entry_price,
    arg_max(close, date) * 0.9985::DOUBLE AS exit_price, count(*) AS days_held FROM pf WHERE position <> 0 GROUP BY 1, 2""",
    "trades": "SELECT *, CASE WHEN p > 0 THEN 'long' ELSE 'short' END AS direction, (exit_price / entry_price - 1) * p AS trade_return FROM tr1",
}


def metrics_sql(src: str, keys: str, order: str, value: str = "strategy_return", name: str = "m") -> dict[str, str]:
    """CTEs computing the performance measures of ``src`` per ``keys``."""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return {
        f"{name}_c": f"SELECT *, product(1 + {value}) OVER ({part}ORDER BY {order}) AS crv FROM {src} WHERE {value} IS NOT NULL",
        f"{name}_d": f"SELECT *, crv / max(crv) OVER ({part}ORDER BY {order}) - 1 AS dd FROM {name}_c",
        f"{name}_a": f"""SELECT {lead}count(*) AS n_days, product(1 + {value}) - 1 AS total_return, stddev_samp({value}) AS sd, avg({value}) AS mu,
        stddev_samp({value}) FILTER (WHERE {value} < 0) AS ds, min(dd) AS max_drawdown FROM {name}_d {group}""",
        f"{name}_b": f"SELECT *, pow(1 + total_return, 252::DOUBLE / n_days) - 1 AS annual_return FROM {name}_a",
        name: f"""SELECT {lead}n_days, total_return, annual_return, sd * sqrt(252) AS annual_vol, CASE WHEN sd > 0 THEN mu / sd * sqrt(252) ELSE 0 END AS sharpe_ratio,
        CASE WHEN ds > 0 THEN mu / ds ELSE 0 END AS sortino_ratio, max_drawdown,
        CASE WHEN max_drawdown < 0 THEN annual_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio FROM {name}_b""",
    }


METRICS = "total_return annual_return annual_vol sharpe_ratio sortino_ratio max_drawdown calmar_ratio"


def _signalled(t):
    return t.bars.withColumn("signal", (c("prob_up") >= 0.5).cast("int"))


def _curve(t):
    return t.store("curve", lambda: bt.portfolio(_signalled(t), capital=1.0))


@query(
    "bt_align",
    ctes("bars", s="SELECT ticker, date, 1 AS signal FROM bars WHERE prob_up >= 0.55::DOUBLE")
    + "SELECT ticker, date, coalesce(signal, 0) AS signal FROM bars LEFT JOIN s USING (ticker, date)",
)
def bt_align(t):
    fired = t.bars.where(c("prob_up") >= 0.55).select("ticker", "date", F.lit(1).alias("signal"))
    return bt.align(t.bars, fired).select("ticker", "date", "signal")


@query(
    "bt_position",
    ctes("bars", **_PF, s=f"SELECT *, coalesce(lag(signal) OVER ({W}) * 2 - 1, 0)::DOUBLE AS position_short FROM pos")
    + f"SELECT {cols('ticker date', 'position position_short')} FROM s",
)
def bt_position(t):
    both = panel.windowed(
        _signalled(t),
        [bt.add_position(True), lambda d: d.withColumnRenamed("position", "position_short"), bt.add_position()],
        back=1,
    )
    return both.select("ticker", "date", "position", "position_short")


for _name, _cols in {"bt_gross": "gross_return", "bt_cost": "cost", "bt_equity": "strategy_return equity"}.items():

    @query(_name, ctes("bars", **_PF) + f"SELECT {cols('ticker date', _cols)} FROM pf")
    def _curve_query(t, names=_cols):
        return _curve(t).select("ticker", "date", *names.split())


@query(
    "bt_trades",
    ctes("bars", **_TR) + f"SELECT {cols('ticker block entry_date exit_date direction days_held', 'entry_price exit_price trade_return')} FROM trades",
)
def bt_trades(t):
    return bt.trades(_curve(t)).select(
        "ticker", "block", "entry_date", "exit_date", "direction", "days_held", "entry_price", "exit_price", "trade_return"
    )


@query(
    "bt_metrics",
    ctes("bars", **_PF, **metrics_sql("pf", "ticker", "date")) + f"SELECT {cols('ticker n_days', METRICS)} FROM m",
)
def bt_metrics(t):
    return bt.metrics(_curve(t), ["ticker"])


@query(
    "bt_drawdown",
    ctes("bars", **_PF, **metrics_sql("pf", "ticker", "date"), o="SELECT ticker, date, dd AS drawdown FROM m_d")
    + f"SELECT {cols('ticker date', 'drawdown')} FROM o",
)
def bt_drawdown(t):
    return bt.drawdowns(_curve(t), ["ticker"], ["seq"], "seg").select("ticker", "date", "drawdown")


_TM = {
    **_TR,
    "tm0": """SELECT ticker, count(*) AS n_trades, avg((trade_return > 0)::INT) AS win_rate, coalesce(sum(trade_return) FILTER (WHERE trade_return > 0), 0) AS g,
    coalesce(-sum(trade_return) FILTER (WHERE trade_return <= 0), 0) AS l, coalesce(avg(trade_return) FILTER (WHERE trade_return > 0), 0) AS avg_win,
    coalesce(avg(trade_return) FILTER (WHERE trade_return <= 0), 0) AS avg_loss, avg(trade_return) AS expectancy FROM trades GROUP BY 1""",
    "runs": "SELECT *, sum((trade_return > 0)::INT) OVER (PARTITION BY ticker ORDER BY entry_date) AS run FROM trades",
    "streak": """SELECT ticker, max(k) AS max_consecutive_losses FROM (SELECT ticker, run, count(*) FILTER (WHERE trade_return <= 0) AS k FROM runs GROUP BY 1, 2) GROUP BY 1""",
    "tm": """SELECT *, CASE WHEN l > 0 THEN g / l WHEN g > 0 THEN NULL ELSE 0 END AS profit_factor,
    CASE WHEN avg_loss <> 0 THEN avg_win / abs(avg_loss) WHEN avg_win > 0 THEN NULL ELSE 0 END AS win_loss_ratio FROM tm0 JOIN streak USING (ticker)""",
}


@query(
    "bt_trade_metrics",
    ctes("bars", **_TM) + f"SELECT {cols('ticker n_trades max_consecutive_losses', 'win_rate profit_factor avg_win avg_loss win_loss_ratio expectancy')} FROM tm",
)
def bt_trade_metrics(t):
    return bt.trade_metrics(bt.trades(_curve(t)))


@query("bt_loss_streak", ctes("bars", **_TM) + "SELECT ticker, max_consecutive_losses FROM streak")
def bt_loss_streak(t):
    closed = bt.trades(_curve(t)).withColumn("_year", F.year("entry_date"))
    return bt.loss_streaks(closed, ["ticker"], ["entry_date"], "_year")


_F20 = f"({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_REG = {
    **_PF,
    "vr": f"SELECT *, close / lag(close) OVER ({W}) - 1 AS r1 FROM pf",
    "vv": f"SELECT *, CASE WHEN count(r1) OVER {_F20} = 20 THEN stddev_samp(r1) OVER {_F20} END AS rv FROM vr",
    "vq": "SELECT ticker, quantile_cont(rv, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM vv GROUP BY 1",
    "lab": "SELECT *, CASE WHEN rv <= q[1] THEN 'low' WHEN rv <= q[2] THEN 'mid' ELSE 'high' END AS vol_regime FROM vv JOIN vq USING (ticker) WHERE rv IS NOT NULL",
    **metrics_sql("lab", "ticker, vol_regime", "date", name="rm"),
}


@query("bt_regime_metrics", ctes("bars", **_REG) + f"SELECT {cols('ticker vol_regime n_days', METRICS)} FROM rm")
def bt_regime_metrics(t):
    return bt.regime_metrics(_curve(t), t.terciles)


@query(
    "bt_walk_forward",
    ctes(
        "bars",
        **_PANEL,
        tested="SELECT DISTINCT date FROM panel WHERE role = 'test'",
        **{
            **_PF,
            "sig": "SELECT b.*, CASE WHEN t.date IS NOT NULL AND prob_up >= 0.5::DOUBLE THEN 1 ELSE 0 END AS signal FROM bars b LEFT JOIN tested t USING (date)",
        },
        **metrics_sql("pf", "ticker", "date"),
    )
    + f"SELECT {cols('ticker n_days', METRICS)} FROM m",
)
def bt_walk_forward(t):
    fired = bt.walk_forward_signals(t.bars, splits.date_folds(t.bars))
    return bt.metrics(bt.portfolio(bt.align(t.bars, fired), capital=1.0), ["ticker"])


_REPORT = {
    **_TM,
    **metrics_sql("pf", "ticker", "date"),
    **{k: v for k, v in _REG.items() if k not in _PF},
    "rep": " UNION ALL ".join(
        [f"SELECT ticker, 'costs' AS section, '{k}' AS metric, {v}::DOUBLE AS value FROM m" for k, v in
         [("commission", 0.0005), ("spread", 0.0005), ("slippage", 0.0005), ("round_trip", 0.003)]]
        + [f"SELECT ticker, 'portfolio', '{k}', {k}::DOUBLE FROM m" for k in ["n_days", *METRICS.split()]]
        + [f"SELECT ticker, 'trades', '{k}', {k}::DOUBLE FROM tm" for k in
           ["n_trades", "max_consecutive_losses", "win_rate", "profit_factor", "avg_win", "avg_loss", "win_loss_ratio", "expectancy"]]
        + [f"SELECT ticker, 'regime ' || vol_regime, '{k}', {k}::DOUBLE FROM rm" for k in ["n_days", *METRICS.split()]]
    ),
}


@query("bt_report", ctes("bars", **_REPORT) + f"SELECT {cols('ticker section metric', 'value')} FROM rep")
def bt_report(t):
    curve = _curve(t)
    return bt.report(
        bt.metrics(curve, ["ticker"]),
        bt.trade_metrics(bt.trades(curve)),
        bt.regime_metrics(curve, t.terciles),
        bt.Costs(),
    )
