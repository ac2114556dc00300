import datetime as dt

from pyspark.sql import functions as F

from barweave.streaming import jobs

TICK = "ticker string, ts timestamp, price double, size double"


def _land(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def _at(hour, minute=0):
    return dt.datetime(2024, 1, 2, hour, minute, tzinfo=dt.timezone.utc)


def test_late_ticks_are_dropped_and_bars_close_once(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: jobs.files(spark, f"{land}/*", TICK)
    _land(spark, land, "a", [("A", _at(9, 5), 1.0, 1.0), ("A", _at(9, 50), 2.0, 1.0), ("A", _at(12), 5.0, 1.0)], TICK)
    jobs.finish(jobs.bars(stream(), out))
    _land(spark, land, "b", [("A", _at(9, 55), 99.0, 1.0), ("A", _at(15), 6.0, 1.0)], TICK)
    jobs.finish(jobs.bars(stream(), out))
    _land(spark, land, "c", [("A", _at(18), 7.0, 1.0)], TICK)
    jobs.finish(jobs.bars(stream(), out))
    rows = spark.read.parquet(f"{out}/bars").orderBy("start").collect()
    assert rows[0]["close"] == 2.0 and rows[0]["high"] == 2.0  # the 9:55 tick came too late
    assert len({r["start"] for r in rows}) == len(rows) and rows[1]["open"] == 5.0


def test_live_bars_show_the_newest_revision(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, row in (("a", ("A", _at(9, 5), 1.0, 1.0)), ("b", ("A", _at(9, 50), 2.0, 1.0))):
        _land(spark, land, name, [row], TICK)
        jobs.finish(jobs.live_bars(jobs.files(spark, f"{land}/*", TICK), out))
    rows = jobs.read_live_bars(spark, out).collect()
    assert len(rows) == 1 and (rows[0]["open"], rows[0]["close"], rows[0]["n_ticks"]) == (1.0, 2.0, 2)


SIGNAL = "batch_id int, ticker string, trade_date date, signal string, side string, conviction_pct double, confidence_pct double, trading_allowed boolean"


def test_second_cycle_does_not_grow_the_store(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.date(2026, 1, 2)
    for run, conviction in ((1, 10.0), (2, 30.0)):
        rows = [(run, t, day, "BUY", "long", conviction, 55.0, True) for t in ("A", "B", "C")]
        _land(spark, land, f"run{run}", rows, SIGNAL)
        jobs.finish(jobs.upsert_signals(jobs.files(spark, f"{land}/*", SIGNAL), out))
    now = jobs.read_signals(spark, out)
    assert now.count() == 3 and now.agg(F.min("conviction_pct")).first()[0] == 30.0
    assert spark.read.parquet(f"{out}/hot").where("run = 1").count() == 3


def test_alert_is_sent_once_across_batches(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    for run in (1, 2):
        rows = [(run, "A", dt.date(2026, 1, 2), "STRONG_BUY", "long", 30.0, 60.0, True), (run, "B", dt.date(2026, 1, 2), "BUY", "long", 3.0, 51.0, True)]
        _land(spark, land, f"run{run}", rows, SIGNAL)
        jobs.finish(jobs.dedup_alerts(jobs.files(spark, f"{land}/*", SIGNAL), out))
    assert [r["ticker"] for r in jobs.read_outbox(spark, out).collect()] == ["A"]


def test_alerts_for_old_dates_are_sent(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    for run, (ticker, day) in enumerate((("A", 20), ("B", 21), ("C", 10), ("A", 20))):
        _land(spark, land, f"run{run}", [(run, ticker, dt.date(2026, 1, day), "STRONG_BUY", "long", 30.0 + run, 60.0, True)], SIGNAL)
        jobs.finish(jobs.dedup_alerts(jobs.files(spark, f"{land}/*", SIGNAL), out))
    rows = jobs.read_outbox(spark, out).collect()
    assert sorted((r["ticker"], r["trade_date"].day) for r in rows) == [("A", 20), ("B", 21), ("C", 10)]


def test_one_alert_has_the_newest_version(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.date(2026, 1, 2)
    _land(spark, land, "run", [(b, "A", day, "STRONG_BUY", "long", float(b), 60.0, True) for b in (2, 9, 4)], SIGNAL)
    jobs.finish(jobs.dedup_alerts(jobs.files(spark, f"{land}/*", SIGNAL), out))
    assert [r["conviction_pct"] for r in jobs.read_outbox(spark, out).collect()] == [9.0]


def test_old_dates_later_batches_and_a_new_base(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: jobs.files(spark, f"{land}/*", SIGNAL)
    for run, (ticker, day, conviction) in enumerate((("a", 5, 1.0), ("B", 6, 2.0), ("A", 5, 3.0), ("B", 6, 4.0), ("", 6, 9.0))):
        _land(spark, land, f"run{run}", [(run, ticker, dt.date(2026, 1, day), "BUY", "long", conviction, 55.0, True)], SIGNAL)
        jobs.finish(jobs.upsert_signals(stream(), out, compact_every=2))
    rows = {(r["ticker"], r["trade_date"].day): r["conviction_pct"] for r in jobs.read_signals(spark, out).collect()}
    assert rows == {("A", 5): 3.0, ("B", 6): 4.0}
    assert [(r["ticker"], r["conviction_pct"]) for r in jobs.read_hot(spark, out).collect()] == [("B", 4.0)]


RECORDED = "ticker string, trade_date date, seq bigint, side string, entry double, stop_loss double, tp1 double"
BAR = "ticker string, seq bigint, date date, high double, low double, close double"


def test_signals_and_bars_resolve_in_any_order(spark, tmp_path):
    at = lambda d: dt.date(2026, 2, 1) + dt.timedelta(days=d)
    bars = [("A", d, at(d), 10.0 + d, 9.0 + d, 9.5 + d) for d in range(30)]
    signals = [("A", at(d), d, "long", 9.5 + d, 8.0 + d, 12.0 + d) for d in (20, 21, 16)]
    steps = [("s", signals[:1]), ("b", bars[10:23]), ("s", signals[1:2]), ("b", bars[23:]), ("s", signals[2:]), ("b", bars[:10])]
    out = str(tmp_path / "out")
    for name, schema in (("s", RECORDED), ("b", BAR)):
        _land(spark, str(tmp_path / name), "none", [], schema)
    for i, (side, rows) in enumerate(steps):
        _land(spark, str(tmp_path / side), f"run{i}", rows, RECORDED if side == "s" else BAR)
        s, b = (jobs.files(spark, f"{tmp_path / n}/*", schema) for n, schema in (("s", RECORDED), ("b", BAR)))
        jobs.finish(jobs.resolve_signals(s, b, out))
    got = {r["trade_date"]: (r["next_close"], r["hit_tp1"], r["hit_sl"]) for r in jobs.read_outcomes(spark, out).collect()}
    assert got == {at(d): (10.5 + d, 1, 0) for d in (20, 21, 16)}
    assert spark.read.parquet(f"{out}/pairs").count() == 15
