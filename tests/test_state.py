"""What grows with a batch and not with the history: resolution, outbox, sinks, positions, pooling."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import calibration, expectancy as ex, outcomes
from barweave.sources import bars as src
from barweave.streaming import jobs

RECORDED = "ticker string, trade_date date, seq bigint, side string, entry double, stop_loss double, tp1 double"
BAR = "ticker string, seq bigint, date date, high double, low double, close double"


def _at(day):
    return dt.date(2020, 1, 1) + dt.timedelta(days=day)


@pytest.fixture(scope="module")
def landed():
    rng = random.Random(3)
    bars = [(t, d, _at(d), 10 + rng.random() * 4, 9 + rng.random(), 10 + rng.random()) for t in "AB" for d in range(1, 301)]
    signals = [(t, _at(d), d, rng.choice(["long", "short"]), 10.2, 9.3, 12.5) for t in "AB" for d in rng.sample(range(1, 301), 120)]
    return bars, signals


def test_resolution_equals_the_batch_and_batches_stay_flat(spark, tmp_path, landed):
    bars, signals = landed
    rng = random.Random(5)
    for name, rows, schema in (("bars", bars, BAR), ("signals", signals, RECORDED)):
        rows = rng.sample(rows, len(rows))
        for k in range(25):
            spark.createDataFrame(rows[k::25], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k:02}")
    one = lambda name, schema: jobs.files(spark, f"{tmp_path}/{name}/*", schema, per_trigger=1)
    query = jobs.resolve_signals(one("signals", RECORDED), one("bars", BAR), str(tmp_path / "out"), block=16)
    jobs.finish(query)
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert len(progress) >= 25
    rows_in = [p.numInputRows for p in progress]
    touched = [p.stateOperators[0].numRowsUpdated for p in progress]
    # state rows written follow the rows of the batch: the last batches write no more than the first ones
    assert max(rows_in) <= 40 and max(touched[-8:]) <= 2.5 * max(touched[:8]) + 20
    got = {(r.ticker, r.trade_date): (r.next_close, r.hit_sl, r.hit_tp1, r.direction_correct) for r in jobs.read_outcomes(spark, str(tmp_path / "out")).collect()}
    prepared = spark.createDataFrame(bars, BAR).withColumn("seg", F.lit(0))
    batch = outcomes.resolve(spark.createDataFrame(signals, RECORDED).drop("seq"), prepared)
    want = {(r.ticker, r.trade_date): (r.next_close, r.hit_sl, r.hit_tp1, r.direction_correct) for r in batch.collect()}
    assert got == want and len(want) > 200


def test_outbox_opens_the_remembered_days_only(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "batch_id int, ticker string, trade_date date, signal string, trading_allowed boolean"
    day = dt.date(2026, 1, 2)
    old = spark.createDataFrame([(0, "A", day, "STRONG_BUY", True)], schema)
    sent = old.withColumn("sent_at", F.lit("2020-01-01").cast("timestamp"))
    sent.write.parquet(f"{out}/outbox/sent_day=2020-01-01/run=77")  # long ago: forgotten, and not even opened
    glob_old = glob.glob(f"{out}/outbox/sent_day=2020-01-01/run=77/*.parquet")
    with open(glob_old[0], "wb") as f:
        f.write(b"not parquet")
    for run in range(3):
        spark.createDataFrame([(run, "A", day, "STRONG_BUY", True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{run}")
        jobs.finish(jobs.dedup_alerts(jobs.files(spark, f"{tmp_path}/in/*", schema), out))
    today = spark.sql("SELECT date(current_timestamp())").first()[0]
    rows = spark.read.parquet(f"{out}/outbox/sent_day={today}").collect()
    assert [(r.ticker, r.run) for r in rows] == [("A", 0)]


def test_a_hot_ticker_gets_several_files(spark, tmp_path):
    rows = spark.range(50_000).select(F.when(F.col("id") % 10 > 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 50)).alias("ticker"), F.col("id").cast("double").alias("close"))
    src.write_processed(rows.repartition(16), str(tmp_path / "p"), rows_a_file=10_000)
    files = {}
    for f in glob.glob(f"{tmp_path}/p/ticker=*/*.parquet"):
        files[f.split("ticker=")[1].split("/")[0]] = files.get(f.split("ticker=")[1].split("/")[0], 0) + 1
    assert files.pop("HOT") >= 5 and files and set(files.values()) == {1}
    assert spark.read.parquet(str(tmp_path / "p")).count() == 50_000


def plain_positions(rows):
    taken, busy = set(), {}
    for ticker, pos, held in sorted(rows):
        if busy.get(ticker, -1) < pos:
            taken.add((ticker, pos))
            busy[ticker] = pos + held
    return taken


def test_positions_are_those_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(ex, "FAN_OUT", 4)
    rng = random.Random(2)
    rows = [(t, pos, rng.randint(1, 20)) for t in "ABC" for pos in sorted(rng.sample(range(1, 6000), 900 if t == "A" else 60))]
    df = spark.createDataFrame(rows, "ticker string, pos_t bigint, held int").withColumn("scenario", F.lit("x"))
    found = ex.one_position(df, ["scenario"], rows=100)  # 60 segments: three levels of four pieces a row
    assert {(r.ticker, r.pos_t) for r in found.collect()} == plain_positions(rows)


def test_a_series_of_very_many_segments(spark):
    n = 100_000
    df = spark.range(1, 21 * n, 11).select(F.lit("A").alias("ticker"), F.col("id").alias("pos_t"), (F.pmod(F.xxhash64("id"), F.lit(20)) + 1).cast("int").alias("held"))
    got = ex.one_position(df, [], rows=21).select("pos_t").toPandas().pos_t
    rows = [("A", r.pos_t, r.held) for r in df.toPandas().itertuples()]
    assert set(got) == {p for _, p in plain_positions(rows)}


def pool(points):
    blocks = []
    for p, y in sorted(points):
        blocks.append([p, p, y, 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return blocks


@pytest.mark.parametrize("pool_rows", [50, 700, 10**6])
def test_isotonic_fit_of_distinct_scores_is_a_plain_loop(spark, monkeypatch, pool_rows):
    monkeypatch.setattr(calibration.pooled, "__defaults__", (pool_rows,))
    rng = random.Random(4)
    points = [((k + rng.random()) / 3000, int(rng.random() < 0.2 + 0.6 * k / 3000)) for k in range(3000)]
    df = spark.createDataFrame(points, "prob_up double, target int")
    out = calibration.Calibrator("isotonic").fit(df).transform(df).collect()
    blocks = pool(points)
    for r in out:
        s, w = next((s, w) for a, b, s, w in blocks if a <= r.prob_up <= b)
        assert r.prob_cal == pytest.approx(min(0.99, max(0.01, s / w)), abs=1e-9)
    assert calibration.pooled(calibration.merged(df)).count() <= len(blocks) + 30 * (3000 // pool_rows + 1)


def plain_portfolio(rows, limit):
    """(ticker, position) that a loop over dates and tickers takes."""
    taken, opened, busy = set(), [], {}
    for day, ticker, pos, held in sorted(rows):
        entry = day + 1
        opened = [end for end in opened if end >= entry]
        if len(opened) < limit and busy.get(ticker, -1) < pos:
            busy[ticker] = pos + held
            opened.append(entry + max(1, int(held * 1.45)))
            taken.add((ticker, pos))
    return taken


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_portfolio_limit_is_a_plain_loop(spark, limit):
    """Many tickers a date, of which the first are busy; dates and scenarios over several batches."""
    rng = random.Random(limit)
    rows = []
    for name in ("x", "y", None):
        for d in range(120):
            for t in rng.sample(range(60), rng.choice([1, 5, 50])):
                rows.append((name, _at(d), f"T{t:02}", d, rng.randint(1, 30 if t < 20 else 3)))
    df = spark.createDataFrame(rows, "scenario string, date date, ticker string, pos_t bigint, held int").withColumn("r", F.lit(1.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.scenario, r.ticker, r.pos_t) for r in ex.max_concurrent(df.repartition(5), ["scenario"], limit).collect()}
        alone = {(r.ticker, r.pos_t) for r in ex.max_concurrent(df.where("scenario = 'x'").drop("scenario"), [], limit).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = lambda name: plain_portfolio([(d.toordinal(), t, p, h) for s, d, t, p, h in rows if s == name], limit)
    assert got == {(s, *x) for s in ("x", "y") for x in plain(s)} and alone == plain("x")


def test_compaction_retires_what_it_replaced(spark, tmp_path):
    """Many batches of bars and signals: folders stay few, and readers see every newest version."""
    ticks, signals = str(tmp_path / "ticks"), str(tmp_path / "signals")
    tick = "ticker string, ts timestamp, price double, size double"
    signal = "batch_id int, ticker string, trade_date date, signal string, side string, conviction_pct double, confidence_pct double, trading_allowed boolean"
    n = 9
    for k in range(n):
        at = dt.datetime(2024, 1, 2, 9 + k // 4, k % 4, tzinfo=dt.timezone.utc)
        spark.createDataFrame([("A", at, float(k), 1.0)], tick).coalesce(1).write.parquet(f"{ticks}/{k:02}")
        rows = [(k, t, dt.date(2026, 1 + k % 3, 5), "BUY", "long", float(k), 55.0, True) for t in "AB"]
        spark.createDataFrame(rows, signal).coalesce(1).write.parquet(f"{signals}/{k:02}")
    stream = lambda path, schema: jobs.files(spark, f"{path}/*", schema, per_trigger=1)
    bars_at, signals_at = str(tmp_path / "b"), str(tmp_path / "s")
    jobs.finish(jobs.live_bars(stream(ticks, tick), bars_at, compact_every=2))
    jobs.finish(jobs.upsert_signals(stream(signals, signal), signals_at, compact_every=2))
    bars = {r.start.hour: (r.open, r.close, r.n_ticks) for r in jobs.read_live_bars(spark, bars_at).collect()}
    assert sorted(bars.values()) == [(0.0, 3.0, 4), (4.0, 7.0, 4), (8.0, 8.0, 1)]
    got = {(r.ticker, r.trade_date.month): r.conviction_pct for r in jobs.read_signals(spark, signals_at).collect()}
    assert got == {(t, m): float(max(k for k in range(n) if 1 + k % 3 == m)) for t in "AB" for m in (1, 2, 3)}
    for log in (f"{bars_at}/revisions", f"{signals_at}/log", f"{bars_at}/base", f"{signals_at}/base", f"{signals_at}/hot"):
        assert len(glob.glob(f"{log}/*=*")) <= 2 * 2 + 1, log
    assert len(glob.glob(f"{signals_at}/base/*")) == 2
