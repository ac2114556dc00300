"""Streaming jobs run over everything that has landed, compared with their batch twins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from barweave.operators import features as f
from barweave.operators import models
from barweave.operators.calibration import Calibrator
from barweave.plans import learning
from barweave.plans.features import _COMPLETE
from barweave.plans.forward import _BILL, _RES, billing_events
from barweave.plans.registry import QUERIES, query
from barweave.plans.signals import _BATCH, _log
from barweave.plans.sources import flat_bars, ticks
from barweave.plans.sqlparts import cols, ctes
from barweave.session import scratch_path
from barweave.streaming import jobs

c = F.col


def _landed(t, name: str, build):
    """A derived table as landed files, with its path and schema."""
    df = t.store(name, build)
    return df.inputFiles()[0].rsplit("/", 1)[0], df.schema


def _event_stream(t):
    schema = t.table("events").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*")


@query("ss_bars", QUERIES["bars_from_ticks"].sql)
def ss_bars(t):
    path = scratch_path(t.spark, "ss-bars")
    jobs.finish(jobs.live_bars(ticks(_event_stream(t)), path))
    return flat_bars(jobs.read_live_bars(t.spark, path))


@query(
    "ss_bars_closed",
    QUERIES["bars_from_ticks"].sql.replace(
        "FROM o", "FROM o WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"
    ),
)
def ss_bars_closed(t):
    path = scratch_path(t.spark, "ss-closed")
    jobs.finish(jobs.bars(ticks(_event_stream(t)), path))
    return flat_bars(t.spark.read.parquet(f"{path}/bars"))


@query("ss_scan_upsert", ctes("signals", **_BATCH) + f"SELECT {cols('ticker trade_date signal regime', 'conviction_pct tp1 tp2')} FROM st")
def ss_scan_upsert(t):
    landed, schema = _landed(t, "log", lambda: _log(t))
    path = scratch_path(t.spark, "ss-signals")
    jobs.finish(jobs.upsert_signals(jobs.files(t.spark, landed, schema), path))
    return jobs.read_signals(t.spark, path).select("ticker", "trade_date", "signal", "regime", "conviction_pct", "tp1", "tp2")


@query(
    "ss_alert_dedup",
    ctes("signals", **_BATCH) + "SELECT DISTINCT ticker, trade_date FROM log WHERE signal IN ('STRONG_BUY', 'STRONG_SELL') AND trading_allowed",
)
def ss_alert_dedup(t):
    landed, schema = _landed(t, "log", lambda: _log(t))
    path = scratch_path(t.spark, "ss-alerts")
    jobs.finish(jobs.dedup_alerts(jobs.files(t.spark, landed, schema), path))
    return jobs.read_outbox(t.spark, path).select("ticker", "trade_date")


@query("ss_resolve", ctes("signals", **_RES) + f"SELECT {cols('ticker trade_date direction_correct hit_sl hit_tp1', 'next_close next_ret_pct')} FROM outc")
def ss_resolve(t):
    signals_at, signal_schema = _landed(t, "recorded", lambda: t.signals.withColumnRenamed("date", "trade_date"))
    bars_at, bar_schema = _landed(t, "bars", t.build_bars)
    path = scratch_path(t.spark, "ss-outcomes")
    recorded = jobs.files(t.spark, signals_at, signal_schema)
    jobs.finish(jobs.resolve_signals(recorded, jobs.files(t.spark, bars_at, bar_schema), path))
    return jobs.read_outcomes(t.spark, path).select(
        "ticker", "trade_date", "direction_correct", "hit_sl", "hit_tp1", "next_close", "next_ret_pct"
    )


@query(
    "ss_account",
    ctes(**_BILL) + "SELECT user_id, status, customer_id, subscription_id, CAST(period_end AS DATE) AS period_end, n_events, CASE WHEN status = 'active' THEN 'pro' ELSE 'free' END AS tier FROM sub",
)
def ss_account(t):
    landed, schema = _landed(t, "billing", lambda: billing_events(t))
    path = scratch_path(t.spark, "ss-accounts")
    jobs.finish(jobs.fold_accounts(jobs.files(t.spark, landed, schema), path))
    return jobs.read_accounts(t.spark, path).select(
        "user_id", "status", "customer_id", "subscription_id", c("period_end").cast("date").alias("period_end"), "n_events", "tier"
    )


_NEWEST = {
    "asked": "SELECT (SELECT max(date) FROM vix) - unnest([0, 40]) AS as_of",
    "complete": _COMPLETE,
    "newest": "SELECT ticker, as_of, max(date) AS date FROM bars JOIN asked ON date <= as_of GROUP BY 1, 2",
}


@query("ss_scan_cycle", ctes("bars", "vix", **_NEWEST) + "SELECT DISTINCT upper(ticker) AS ticker, date AS trade_date, true AS valid FROM complete SEMI JOIN newest USING (ticker, date)")
def ss_scan_cycle(t):
    """Two requests, scored by the registered ensemble; each is one batch, and a second run adds nothing."""
    model = models.Registry(t.spark).fit(learning._training(t), f.MODEL_FEATURES)
    calibrator = Calibrator("isotonic").fit(t.oof)
    last = t.vix.agg(F.max("date")).first()[0]
    path, asked = scratch_path(t.spark, "ss-cycle"), scratch_path(t.spark, "requests")
    for k, days in enumerate((40, 0)):
        t.spark.createDataFrame([(last - timedelta(days=days),)], "as_of date").coalesce(1).write.parquet(f"{asked}/{k}")
    upto = lambda df, day: df.where(c("date") <= F.lit(day))
    for _ in range(2):
        requests = jobs.files(t.spark, f"{asked}/*", "as_of date", per_trigger=1)
        jobs.finish(jobs.scan_cycles(requests, path, lambda day: (upto(t.bars, day), upto(t.features, day), upto(t.vix, day)), model, calibrator))
    found = jobs.read_signals(t.spark, path)
    inside = c("prob_up").between(0.01, 0.99) & c("confidence_pct").between(0, 100) & c("signal").isNotNull() & c("regime").isNotNull()
    return found.select("ticker", "trade_date", inside.alias("valid"))
