import numpy as np
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barweave.operators import levels, regime, screener, signals, store


def _vix(spark, level, n=400, start="2017-06-01"):
    days = f"sequence(date'{start}', date_add(date'{start}', {n * 3}))"
    return spark.range(1).select(F.explode(F.expr(days)).alias("date"), F.lit(float(level)).alias("close"))


def test_class_boundaries(spark):
    df = spark.createDataFrame([(p,) for p in (0.55, 0.549, 0.5, 0.499, 0.45, 0.44)], "prob_up double")
    got = [r["signal"] for r in signals.add_grade(df).collect()]
    # 1 - 0.55 is slightly below 0.45 in doubles
    assert got == ["STRONG_BUY", "BUY", "BUY", "SELL", "SELL", "STRONG_SELL"]


@pytest.mark.parametrize("level,status", [(15, "normal"), (27, "caution"), (40, "suspended")])
def test_volatility_gauge_sets_the_regime(spark, make_bars, level, status):
    bars = make_bars(walk("A", 200, sigma=0.01))
    last = signals.latest(regime.regimes(bars, _vix(spark, level))).first()
    assert last["status"] == status
    assert last["position_scale"] == {"normal": 1.0, "caution": 0.5, "suspended": 0.0}[status]


def test_opening_gap_suspends(spark, make_bars):
    pdf = walk("A", 200, sigma=0.01)
    prev = pdf.close.iloc[-2]
    pdf.loc[199, ["open", "high", "low", "close"]] = [prev * 1.15, prev * 1.16, prev * 1.14, prev * 1.15]
    row = signals.latest(regime.add_reasons(regime.regimes(make_bars(pdf), _vix(spark, 15)))).first()
    assert row["status"] == "suspended" and "opening gap" in row["reasons"][-1]


def test_short_history_is_cautious(spark, make_bars):
    row = signals.latest(regime.regimes(make_bars(walk("A", 15)), _vix(spark, 15))).first()
    assert row["status"] == "caution"


def test_vix_is_taken_as_of_the_bar(spark, make_bars):
    bars = make_bars(walk("A", 10))
    vix = spark.createDataFrame([("2017-12-20", 11.0), ("2018-01-04", 12.0)], "date string, close double")
    got = regime.join_vix_asof(bars, vix.withColumn("date", F.to_date("date"))).orderBy("date").collect()
    assert [r["vix_level"] for r in got[:4]] == [11.0, 11.0, 11.0, 12.0] and got[-1]["vix_level"] == 12.0


def test_built_signals_keep_the_contract(spark, make_bars):
    frames = [walk(t, 300, seed=s) for t, s in (("A", 5), ("B", 9), ("C", 11), ("D", 3))]
    for i, pdf in enumerate(frames):
        pdf.loc[299, "prob_up"] = (0.62, 0.38, 0.5, 0.45)[i]
    rows = {r["ticker"]: r for r in signals.build(make_bars(*frames), _vix(spark, 15)).collect()}
    for r in rows.values():
        sign = 1 if r["side"] == "long" else -1
        assert sign * (r["entry"] - r["stop_loss"]) > 0
        last = r["take_profits"][-1]
        assert last["name"] == "TP2" and sign * (last["price"] - r["entry"]) > 0
        assert r["risk_reward"] >= 2 - 1e-9
        assert 0 < r["base_size_pct"] <= 100
        assert len(r["supports"]) <= 4 and r["supports"] == sorted(r["supports"])
    assert rows["A"]["signal"] == "STRONG_BUY" and rows["B"]["signal"] == "STRONG_SELL"
    halted = signals.build(make_bars(*frames), _vix(spark, 40)).first()
    assert not halted["trading_allowed"] and halted["position_size_pct"] == 0


def test_pivots_and_zones_on_a_sine(make_bars):
    pdf = walk("S", 200)
    close = 100 + 10 * np.sin(np.arange(200) / 8)
    pdf = pdf.assign(open=close, close=close, high=close + 0.5, low=close - 0.5)
    zones = levels.zones(levels.pivots(make_bars(pdf))).collect()
    assert sorted(r["kind"] for r in zones) == ["resistance", "support"]
    top = next(r for r in zones if r["kind"] == "resistance")
    assert abs(top["level"] - 110.5) < 0.2 and top["n_pivots"] >= 3


def test_missing_atr_gives_no_levels(spark):
    df = spark.createDataFrame([("A", "long", 100.0, 0.0)], "ticker string, side string, price double, atr double")
    empty = F.array().cast("array<double>")
    row = levels.add_levels(df.withColumns({"supports": empty, "resistances": empty})).first()
    assert row["entry"] is None and row["stop_loss"] is None and row["take_profits"] == []


def test_filters_and_store(spark):
    rows = [
        ("A", "2026-01-02", "STRONG_BUY", "long", 60.0, 20.0, True, 1.0),
        ("B", "2026-01-02", "SELL", "short", 52.0, 4.0, False, None),
        ("a", "2026-01-02", "BUY", "long", 51.0, 2.0, True, 1.0),
        ("", "2026-01-02", "BUY", "long", 51.0, 2.0, True, 1.0),
        ("C", "2026-01-01", "BUY", "long", 53.0, 6.0, True, 2.0),
    ]
    schema = "ticker string, trade_date string, signal string, side string, confidence_pct double, conviction_pct double, trading_allowed boolean, atr_pct double"
    df = spark.createDataFrame(rows, schema).withColumn("trade_date", F.to_date("trade_date"))
    assert {r["ticker"] for r in screener.matching(df, max_atr_pct=1.5).collect()} == {"A", "a", ""}
    assert screener.matching(df, side="short", only_tradable=True).count() == 0
    log = store.to_log(df.where("signal <> 'BUY' or ticker = 'C'"), 1).unionByName(store.to_log(df.where("signal = 'BUY'"), 2))
    now = store.current(log)
    assert now.count() == 3  # the later BUY replaced A, the row without ticker is gone
    assert {r["ticker"]: r["signal"] for r in now.collect()} == {"A": "BUY", "B": "SELL", "C": "BUY"}
    assert store.current(log.unionByName(log)).count() == 3
    assert [r["ticker"] for r in store.latest(now, side="buy", signals=["buy"]).collect()] == ["A"]
    assert store.latest(now, min_confidence=52).first()["ticker"] == "B"


def test_gauge_rows_without_a_close_say_nothing(spark):
    import datetime as dt

    from barweave.operators import regime

    days = [dt.date(2026, 1, d) for d in (1, 2, 3)]
    vix = spark.createDataFrame(list(zip(days, [15.0, None, 18.0])), "date date, close double")
    bars = spark.createDataFrame([("A", d) for d in days], "ticker string, date date")
    got = {r["date"]: r["vix_level"] for r in regime.join_vix_asof(bars, vix).collect()}
    assert got == dict(zip(days, [15.0, 15.0, 18.0]))


def test_ties_in_the_log_do_not_depend_on_the_plan(spark):
    from barweave.operators import store

    rows = [("A", "2026-01-02", 1, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "ticker string, trade_date string, batch_id int, conviction_pct double")
    picks = {store.current(df.repartition(n)).first()["conviction_pct"] for n in (1, 2, 7)}
    assert len(picks) == 1


def test_surrogate_pressure_is_the_probability_of_the_model(spark):
    import math

    from barweave.operators import explain, models

    rows = [("A", i, float(i % 7), float((i * 5) % 11), int((i % 7) + (i * 5) % 11 > 11 or i % 9 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double, y double, target int")
    coef, mean, base = models.surrogate(df, ["x", "y"])
    got = explain.pressure(explain.contributions(df, coef, mean), base).collect()
    want = {r["date"]: base + sum(coef[k] * (r[k] - mean[k]) for k in ("x", "y")) for r in df.collect()}
    assert base != 0 and all(math.isclose(r["prob_up"], 1 / (1 + math.exp(-want[r["date"]])), rel_tol=1e-9) for r in got)
