import json

import pytest
from conftest import walk
from pyspark.sql import functions as F

from barweave.operators import accounts, alerts, outcomes, store
from barweave.sources import bars as src
from barweave.sources import universe as uni


@pytest.fixture()
def three_bars(make_bars):
    def build(highs, lows, closes):
        pdf = walk("A", len(closes)).assign(open=closes, high=highs, low=lows, close=closes)
        return make_bars(pdf), pdf.date[0]

    return build


def _signal(spark, day, side="long", tp1=104.0, sl=98.0):
    schema = "ticker string, trade_date date, side string, signal string, entry double, stop_loss double, tp1 double, position_size_pct double"
    return spark.createDataFrame([("A", day, side, "BUY", 100.0, sl, tp1, 50.0)], schema)


def test_target_and_stop_outcomes(spark, three_bars):
    bars, day = three_bars([100.0, 103.0, 105.0], [100.0, 99.0, 101.0], [100.0, 102.0, 104.0])
    r = outcomes.resolve(_signal(spark, day), bars).first()
    assert (r["hit_tp1"], r["hit_sl"], r["direction_correct"]) == (1, 0, 1) and r["next_ret_pct"] == pytest.approx(2.0)
    bars, day = three_bars([100.0, 106.0, 105.0], [100.0, 97.0, 101.0], [100.0, 99.0, 104.0])
    r = outcomes.resolve(_signal(spark, day), bars).first()
    assert (r["hit_tp1"], r["hit_sl"], r["direction_correct"]) == (0, 1, 0)


def test_without_a_later_bar_it_stays_pending(spark, three_bars):
    bars, day = three_bars([100.0], [100.0], [100.0])
    signal = _signal(spark, day)
    done = outcomes.resolve(signal, bars)
    assert done.count() == 0 and outcomes.pending(signal, done).count() == 1
    assert outcomes.import_if_empty(signal, signal).count() == 0
    assert outcomes.import_if_empty(signal.limit(0), signal).count() == 1


def test_performance_weights_by_size(spark, three_bars):
    bars, day = three_bars([100.0, 103.0, 105.0], [100.0, 99.0, 101.0], [100.0, 102.0, 104.0])
    p = outcomes.performance(outcomes.resolve(_signal(spark, day), bars)).first()
    assert p["total_return"] == pytest.approx(0.01) and p["profit_factor"] is None and p["n_resolved"] == 1


def test_alerts_once_and_only_strong(spark):
    rows = [("A", "2026-01-02", "STRONG_BUY", True), ("A", "2026-01-02", "STRONG_BUY", True), ("B", "2026-01-02", "BUY", True),
            ("C", "2026-01-02", "STRONG_SELL", False), ("D", "2026-01-02", "strong_sell", True)]
    df = spark.createDataFrame(rows, "ticker string, trade_date string, signal string, trading_allowed boolean")
    picked = alerts.select(df)
    assert picked.count() == 3
    fresh = alerts.unsent(picked, picked.where("ticker = 'D'"))
    assert [r["ticker"] for r in fresh.collect()] == ["A"]
    users = spark.createDataFrame(
        [(1, "a@x", "", "pro"), (2, "", " 7 ", ""), (3, "c@x", "9", "free"), (4, " ", "", "pro")],
        "user_id long, email string, chat_id string, tier string",
    )
    assert {r["user_id"] for r in alerts.subscribers(users).collect()} == {1, 2}
    box = {r["channel"]: r["recipients"] for r in alerts.outbox(fresh, users).collect()}
    assert box == {"chat": 1, "email": 1}


def _event(kind, **obj):
    return json.dumps({"type": kind, "data": {"object": obj}})


def test_billing_events_fold_to_one_row_per_user(spark):
    meta = {"user_id": "7"}
    rows = [
        (1, 1, _event("checkout.session.completed", client_reference_id="7", customer="cus_1", subscription="sub_1")),
        (2, 2, _event("customer.subscription.updated", id="", status="active", current_period_end=1_700_000_000, metadata=meta)),
        (3, 3, _event("invoice.paid", metadata=meta)),
        (4, 4, _event("checkout.session.completed", customer="cus_9")),
        (5, 5, _event("checkout.session.completed", client_reference_id="8")),
    ]
    raw = spark.createDataFrame(rows, "event_ts long, event_id long, payload string")
    got = {r["user_id"]: r for r in accounts.fold_events(accounts.parse_events(raw)).collect()}
    assert set(got) == {7, 8}
    assert got[7]["tier"] == "pro" and got[7]["customer_id"] == "cus_1" and got[7]["subscription_id"] == "sub_1"
    assert got[7]["period_end"] is not None
    gone = raw.unionByName(spark.createDataFrame([(9, 9, _event("customer.subscription.deleted", id="sub_1", metadata=meta))], raw.schema))
    after = {r["user_id"]: r for r in accounts.fold_events(accounts.parse_events(gone)).collect()}
    assert after[7]["tier"] == "free" and after[7]["status"] == "canceled" and after[7]["period_end"] is not None


def test_users_are_created_free_and_keep_their_tier(spark):
    old = spark.createDataFrame([("a@x.test", "", "pro")], "email string, display_name string, tier string")
    seen = spark.createDataFrame([(" A@x.test ", "Ann"), ("b@x.test", ""), ("", "x")], "email string, display_name string")
    got = {r["email"]: (r["display_name"], r["tier"]) for r in accounts.upsert_users(old, seen).collect()}
    assert got == {"a@x.test": ("Ann", "pro"), "b@x.test": ("b", "free")}


def test_watchlists(spark):
    raw = spark.createDataFrame([("mine", [" aapl", "AAPL", "msft"])], "name string, tickers array<string>")
    lists = store.create_lists(raw)
    assert lists.first()["tickers"] == ["AAPL", "MSFT"]
    assert store.new_lists(lists, raw).count() == 0
    assert store.add_tickers(lists, ["amd "]).first()["tickers"] == ["AAPL", "AMD", "MSFT"]
    assert store.remove_tickers(lists, ["aapl"]).first()["tickers"] == ["MSFT"]
    assert store.delete_lists(lists, lists).count() == 0 and store.get_list(lists, "none").count() == 0


def test_sources(spark, tmp_path, make_bars):
    (tmp_path / "AAA_raw.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02 00:00:00-05:00,1,2,0.5,1.5,10\n2024-01-02 23:30:00-05:00,1,2,0.5,1.6,10\n")
    got = src.read_csv(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r["ticker"], str(r["date"]), r["close"]) for r in got] == [("AAA", "2024-01-02", 1.5), ("AAA", "2024-01-03", 1.6)]
    assert [src.period_days(p) for p in ("1d", "5d", "7y", "45d", "max", "2Y")] == [2, 7, 366, 45, 366, 731]
    kinds = spark.createDataFrame([("eurusd=x",), ("btc-usd",), ("ETH-BTC",), ("BRK-B",)], "s string")
    rows = kinds.select(src.symbol_kind(F.col("s")).alias("k"), src.native_symbol(F.col("s")).alias("n")).collect()
    assert [(r["k"], r["n"]) for r in rows] == [("fx", "EURUSD"), ("crypto", "BTCUSD"), ("crypto", None), ("equity", None)]
    empty = spark.createDataFrame([], "ticker string, name string, sector string, exchange string")
    assert uni.or_fallback(empty).count() == 60 and len(uni.NDX100) == 60


def test_canonical_fills_missing_columns(spark):
    df = spark.createDataFrame([("A", "2024-01-02", "1.5", None)], "ticker string, Date string, Close string, High string")
    r = src.canonical(df).first()
    assert (r["close"], r["high"], r["volume"], r["open"]) == (1.5, 0.0, 0.0, 0.0)


def test_contributions_with_their_base_add_up_to_the_log_odds(spark):
    from barweave.operators import explain

    df = spark.createDataFrame([("A", "2024-01-02", 3.0, 1.0), ("B", "2024-01-02", -1.0, 4.0)], "ticker string, date string, x double, y double")
    coef, mean, base = {"x": 0.5, "y": -2.0}, {"x": 1.0, "y": 2.0}, 0.7
    rows = explain.contributions(df, coef, mean, base).collect()
    total = {t: sum(r["value"] for r in rows if r["ticker"] == t) for t in "AB"}
    assert len(rows) == 6 and abs(total["A"] - (0.7 + 0.5 * 2 + 2.0)) < 1e-12 and abs(total["B"] - (0.7 - 1.0 - 4.0)) < 1e-12
    assert all(r["raw"] is None for r in rows if r["feature"] == explain.BASE)
