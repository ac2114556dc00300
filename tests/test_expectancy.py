import pandas as pd
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barweave.operators import expectancy as ex


def _resolve(spark, side, path, rr=2.0, entry=100.0):
    """One decision with a 2 % risk and the given (high, low, close) bars."""
    schema = "side string, entry double, atr_t double, close_t double, path array<struct<high: double, low: double, close: double>>"
    df = spark.createDataFrame([(side, entry, 2.0 / 1.5, 100.0, path)], schema)
    return ex.first_touch(ex.entry_levels(df, F.lit(rr))).first()


COST = 0.001 / 0.02


@pytest.mark.parametrize(
    "side,path,outcome,r,held",
    [
        ("long", [(105.0, 97.0, 101.0)], "sl", -1 - COST, 1),  # both levels in one bar: the stop counts
        ("long", [(101.0, 99.0, 100.0), (104.5, 99.5, 104.0)], "tp", 2 - COST, 2),
        ("long", [(101.0, 99.0, 100.0), (101.0, 99.0, 101.0)], "timeout", 0.5 - COST, 2),
        ("short", [(101.0, 95.5, 96.0)], "tp", 2 - COST, 1),
        ("short", [(102.5, 99.0, 102.0)], "sl", -1 - COST, 1),
        ("short", [(101.0, 99.0, 99.0)], "timeout", 0.5 - COST, 1),
    ],
)
def test_first_touch(spark, side, path, outcome, r, held):
    row = _resolve(spark, side, path)
    assert row["outcome"] == outcome and row["held"] == held and row["r"] == pytest.approx(r)


def test_risk_is_clipped(spark):
    schema = "side string, entry double, atr_t double, close_t double"
    rows = [("long", 100.0, 0.1, 100.0), ("long", 100.0, 50.0, 100.0)]
    got = ex.entry_levels(spark.createDataFrame(rows, schema), F.lit(2.0)).orderBy("atr_t").collect()
    assert [r["risk_pct"] for r in got] == [0.01, 0.05]
    assert got[0]["sl"] == pytest.approx(99) and got[0]["tp"] == pytest.approx(102)


def test_gates(spark):
    rows = [("A", "long", 20.0, 5.0, 4.0), ("B", "long", 40.0, 5.0, 4.0), ("C", "long", None, 5.0, None), ("D", "short", 10.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "ticker string, side string, vix_t double, spy_t double, spy_sma50_t double")
    assert {r["ticker"] for r in ex.gate_vix(df, 30).collect()} == {"A", "C", "D"}
    assert {r["ticker"] for r in ex.gate_trend(df).collect()} == {"A", "B", "D"}
    assert [ex.side_for(F.lit(p), 0.6) is not None for p in (0.6,)] == [True]


def test_measures_match_a_plain_loop(spark):
    rs = [1.9, -1.05, -1.05, 1.9, 0.4, -1.05, 1.9]
    days = pd.bdate_range("2024-01-30", periods=len(rs)).date
    pdf = pd.DataFrame({"ticker": "A", "date": days, "r": rs, "held": [3, 2, 1, 5, 20, 2, 4], "side": "long", "outcome": "tp"})
    got = ex.metrics(spark.createDataFrame(pdf), []).first()
    eq, peak, dd = 1.0, 1.0, 0.0
    for r in rs:
        eq *= 1 + 0.01 * r
        peak = max(peak, eq)
        dd = min(dd, eq / peak - 1)
    s = pd.Series(rs) * 0.01
    years = (days[-1] - days[0]).days / 365.25
    assert got["n_trades"] == 7 and got["win_rate"] == pytest.approx(4 / 7)
    assert got["profit_factor"] == pytest.approx((1.9 * 3 + 0.4) / (1.05 * 3))
    assert got["total_return_pct"] == pytest.approx((eq - 1) * 100) and got["max_drawdown_pct"] == pytest.approx(dd * 100)
    assert got["sharpe"] == pytest.approx(s.mean() / s.std(ddof=0) * (7 / years) ** 0.5)


def test_drawdown_counts_from_the_initial_capital(spark):
    df = spark.createDataFrame([("A", "2024-01-02", -1.0, 1)], "ticker string, date string, r double, held int")
    assert ex.metrics(df.withColumn("date", F.to_date("date")), []).first()["max_drawdown_pct"] == pytest.approx(-1.0)


def test_blocks_are_named_by_their_targets(spark, make_bars):
    a, b = walk("AAA", 40), walk("BBB", 40, seed=21)
    bars = make_bars(a, b)
    rows, i = [], 0
    for pdf, lo, hi in ((a, 0, 29), (b, 10, 34), (a, 5, 30)):
        up = (pdf.close.shift(-1) > pdf.close).astype(int)
        for k in range(lo, hi):
            i += 1
            rows.append((i, pdf.date[k], int(up[k])))
    noise = [(i + 1 + k, a.date[k], int((k * 7) % 3 == 0)) for k in range(25)]
    legacy = spark.createDataFrame(rows + noise, "row_id long, date date, target int")
    blocks = ex.add_blocks(legacy, segment_rows=16)
    named = {r["block"]: r for r in ex.match_blocks(blocks, bars).collect()}
    assert [named[k]["ticker"] for k in range(4)] == ["AAA", "BBB", "AAA", None]
    assert sum(r["n_rows"] for r in named.values() if r["ticker"]) == 29 + 24 + 25
    assert all(r["n_rows"] == r["n_dates"] for r in ex.block_checks(blocks).collect())


def test_drift_market_is_profitable_for_longs(spark, make_bars):
    n = 200
    close = [100 * 1.004**i for i in range(n)]
    pdf = walk("UP", n).assign(open=close, close=close, high=[x * 1.006 for x in close], low=[x * 0.997 for x in close], prob_up=0.62)
    bars = make_bars(pdf)
    oof = bars.select("ticker", "date", "prob_up", F.lit(1).alias("target"))
    ctx = bars.select("date", F.lit(14.0).alias("close"))
    res = ex.resolve(ex.attach(oof, bars, ctx, ctx), [2.0])
    m = ex.metrics(ex.one_position(ex.into_scenarios(res, [0.6]), ["prob_min"]), ["prob_min"]).first()
    assert m["n_trades"] >= 5 and m["expectancy_r"] > 0.2 and (m["profit_factor"] is None or m["profit_factor"] > 1.3)


def test_thinned_equity_keeps_every_nth_point(spark):
    pdf = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=1000).date, "r": 0.1, "held": 1})
    thin = ex.thin_equity(ex.equity(spark.createDataFrame(pdf), []), [], points=100)
    assert [r["seq"] for r in thin.orderBy("seq").collect()] == list(range(10, 1001, 10))
