import pytest
from conftest import walk
from pyspark.sql import functions as F

from barweave.operators import backtest as bt


def _wave(n=300):
    pdf = walk("W", n)
    close, out = 100.0, []
    for i in range(n):
        close *= 1.01 if (i // 5) % 2 == 0 else 0.99
        out.append(close)
    return pdf.assign(open=out, close=out, high=out, low=out)


def test_hand_computed_trade_metrics(spark):
    rets = [0.05, -0.02, 0.03, -0.01, -0.01]
    df = spark.createDataFrame([("T", f"2024-01-0{i + 1}", r) for i, r in enumerate(rets)], "ticker string, entry_date string, trade_return double")
    m = bt.trade_metrics(df.withColumn("entry_date", F.to_date("entry_date"))).first()
    assert m["n_trades"] == 5 and m["win_rate"] == pytest.approx(0.4) and m["profit_factor"] == pytest.approx(2.0)
    assert m["max_consecutive_losses"] == 2 and m["expectancy"] == pytest.approx(0.008)


def test_profit_factor_without_losses_is_unbounded(spark):
    df = spark.createDataFrame([("T", "2024-01-01", 0.1)], "ticker string, entry_date string, trade_return double")
    m = bt.trade_metrics(df.withColumn("entry_date", F.to_date("entry_date"))).first()
    assert m["profit_factor"] is None and m["win_loss_ratio"] is None


def test_flat_market_earns_only_costs(make_bars):
    flat = walk("F", 50).assign(open=100.0, high=100.0, low=100.0, close=100.0)
    curve = bt.portfolio(make_bars(flat).withColumn("signal", F.lit(0)))
    assert curve.agg(F.sum("strategy_return")).first()[0] == 0
    m = bt.metrics(curve, ["ticker"]).first()
    assert m["sharpe_ratio"] == 0 and m["max_drawdown"] == 0 and m["total_return"] == 0


def test_more_cost_less_return(make_bars):
    bars = make_bars(_wave()).withColumn("signal", (F.col("close") > F.lit(100)).cast("int"))
    total = lambda costs: bt.metrics(bt.portfolio(bars, costs), ["ticker"]).first()["total_return"]
    assert total(bt.Costs(0.002, 0.002, 0.002)) < total(bt.Costs(0, 0, 0))


def test_position_lags_the_signal_and_return_lags_the_position(make_bars):
    pdf = walk("A", 10)
    bars = make_bars(pdf).withColumn("signal", (F.col("seq") == 3).cast("int"))
    out = bt.portfolio(bars, bt.Costs(0, 0, 0)).toPandas().sort_values("seq").reset_index(drop=True)
    assert out.position.tolist() == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert out.gross_return.ne(0).tolist() == [i == 4 for i in range(10)]
    assert out.gross_return[4] == pytest.approx(pdf.open[4] / pdf.open[3] - 1)


def test_shorts_start_flat_and_costs_hit_every_change(make_bars):
    bars = make_bars(walk("A", 6)).withColumn("signal", (F.col("seq") % 2).cast("int"))
    out = bt.portfolio(bars, allow_short=True).toPandas().sort_values("seq")
    assert out.position.tolist() == [0, 1, -1, 1, -1, 1]
    assert out.cost.tolist() == pytest.approx([0, 0.003, 0.006, 0.006, 0.006, 0.006])


def test_trades_are_runs_of_constant_position(make_bars):
    pdf = walk("A", 12)
    fired = [1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 1, 1]
    bars = make_bars(pdf).withColumn("signal", F.element_at(F.array(*map(F.lit, fired)), F.col("seq").cast("int")))
    t = bt.trades(bt.portfolio(bars)).orderBy("entry_date").toPandas()
    assert t.days_held.tolist() == [3, 2, 1]
    assert t.entry_price[0] == pytest.approx(pdf.open[1] * 1.0015) and t.exit_price[0] == pytest.approx(pdf.close[3] * 0.9985)


def test_metrics_match_pandas(make_bars):
    bars = make_bars(_wave(), walk("R", 500)).withColumn("signal", (F.col("prob_up") > 0.5).cast("int"))
    curve = bt.portfolio(bars, rows=64).toPandas()
    got = {r["ticker"]: r for r in bt.metrics(bt.portfolio(bars, rows=64), ["ticker"]).collect()}
    for t, g in curve.sort_values("seq").groupby("ticker"):
        r = g.strategy_return
        eq = (1 + r).cumprod()
        assert got[t]["total_return"] == pytest.approx(eq.iloc[-1] - 1)
        assert got[t]["max_drawdown"] == pytest.approx((eq / eq.cummax() - 1).min())
        assert got[t]["annual_vol"] == pytest.approx(r.std() * 252**0.5)
        assert got[t]["sortino_ratio"] == pytest.approx(r.mean() / r[r < 0].std())
        assert g.equity.iloc[-1] == pytest.approx(100_000 * eq.iloc[-1])


def test_report_renders():
    rows = [{"section": "costs", "metric": "spread", "value": 0.0005}, {"section": "trades", "metric": "profit_factor", "value": None}]
    text = bt.markdown(rows)
    assert "| spread | 0.0005 |" in text and "| profit_factor | inf |" in text
