"""Queries over forward-test outcomes, explanations, alerts and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import accounts, alerts, explain, outcomes, store
from barweave.operators.signals import latest
from barweave.plans.backtests import METRICS, metrics_sql
from barweave.plans.registry import query
from barweave.plans.signals import _BATCH, _log
from barweave.plans.sqlparts import W, cols, ctes, full

c = F.col

# --- forward test ---------------------------------------------------------------

_CUT = "2000-06-30"


def _recorded(t):
    return t.signals.withColumnRenamed("date", "trade_date")


def _resolved(t):
    return t.store("outcomes", lambda: outcomes.resolve(_recorded(t), t.bars))


def _known(t):
    return _resolved(t).where(c("trade_date") < F.lit(_CUT).cast("date"))


_RES = {
    "pth": """SELECT s.ticker, s.date AS trade_date, s.signal, s.side, s.entry, s.stop_loss, s.tp1, s.position_size_pct, s.conviction_pct, b.seq - s.seq AS k, b.close AS px,
    CASE WHEN side = 'long' THEN b.low <= stop_loss ELSE b.high >= stop_loss END AS hs, CASE WHEN side = 'long' THEN b.high >= tp1 ELSE b.low <= tp1 END AS ht
    FROM signals s JOIN bars b ON b.ticker = s.ticker AND b.seq BETWEEN s.seq + 1 AND s.seq + 5""",
    "agg": """SELECT ticker, trade_date, any_value(signal) AS signal, any_value(side) AS side, any_value(entry) AS entry, any_value(position_size_pct) AS position_size_pct,
    arg_min(px, k) AS next_close, min(k) FILTER (WHERE hs) AS isl, min(k) FILTER (WHERE ht) AS itp FROM pth GROUP BY 1, 2""",
    "out0": """SELECT *, (next_close / entry - 1) * 100 * CASE WHEN side = 'long' THEN 1 ELSE -1 END AS next_ret_pct FROM agg""",
    "outc": """SELECT *, coalesce(CAST(next_ret_pct > 0 AS INTEGER), 0) AS direction_correct,
    CAST(entry IS NOT NULL AND isl IS NOT NULL AND (itp IS NULL OR isl <= itp) AS INTEGER) AS hit_sl,
    CAST(entry IS NOT NULL AND itp IS NOT NULL AND (isl IS NULL OR itp < isl) AS INTEGER) AS hit_tp1 FROM out0""",
}


@query("pt_record", ctes("signals", **_BATCH) + f"SELECT {cols('ticker trade_date signal side regime', 'entry stop_loss tp1 tp2 position_size_pct')} FROM st")
def pt_record(t):
    return outcomes.record(_log(t)).select(
        "ticker", "trade_date", "signal", "side", "regime", "entry", "stop_loss", "tp1", "tp2", "position_size_pct"
    )


@query(
    "pt_pending",
    ctes("signals", **_RES) + f"SELECT ticker, date AS trade_date, signal FROM signals s WHERE NOT EXISTS (SELECT 1 FROM outc o WHERE o.ticker = s.ticker AND o.trade_date = s.date AND o.trade_date < DATE '{_CUT}')",
)
def pt_pending(t):
    return outcomes.pending(_recorded(t), _known(t)).select("ticker", "trade_date", "signal")


@query("pt_resolve", ctes("signals", **_RES) + f"SELECT {cols('ticker trade_date direction_correct hit_sl hit_tp1', 'next_close next_ret_pct')} FROM outc")
def pt_resolve(t):
    return outcomes.resolve(_recorded(t), t.bars).select(
        "ticker", "trade_date", "direction_correct", "hit_sl", "hit_tp1", "next_close", "next_ret_pct"
    )


@query(
    "pt_performance",
    ctes("signals", **_RES,
         daily="SELECT trade_date, avg(next_ret_pct / 100 * greatest(least(coalesce(position_size_pct, 0) / 100, 1), 0)) AS strategy_return FROM outc GROUP BY 1",
         **metrics_sql("daily", "", "trade_date"),
         st="""SELECT count(*) AS n_resolved, avg(direction_correct) AS directional_accuracy, avg(coalesce((next_ret_pct > 0)::INT, 0)) AS win_rate,
         CAST(sum(hit_tp1) AS BIGINT) AS hit_tp1, CAST(sum(hit_sl) AS BIGINT) AS hit_sl,
         sum(CASE WHEN next_ret_pct > 0 THEN next_ret_pct ELSE 0 END) / nullif(sum(CASE WHEN next_ret_pct <= 0 THEN -next_ret_pct ELSE 0 END), 0) AS profit_factor,
         avg(next_ret_pct) AS avg_return_pct, min(trade_date) AS first_date, max(trade_date) AS last_date FROM outc""")
    + f"SELECT {cols('n_resolved hit_tp1 hit_sl first_date last_date n_days', 'directional_accuracy win_rate profit_factor avg_return_pct ' + METRICS)} FROM st, m",
)
def pt_performance(t):
    return outcomes.performance(_resolved(t))


@query(
    "pt_by_signal",
    ctes("signals", **_RES, o="SELECT signal, count(next_ret_pct) AS n, avg(next_ret_pct) AS mean_ret_pct FROM outc GROUP BY 1") + f"SELECT {cols('signal n', 'mean_ret_pct')} FROM o",
)
def pt_by_signal(t):
    return outcomes.by_signal(_resolved(t))


@query(
    "pt_list",
    ctes("signals", **_RES, o=f"""SELECT s.ticker, s.date AS trade_date, s.signal, o.next_ret_pct, o.hit_tp1, o.hit_sl FROM signals s
    LEFT JOIN outc o ON o.ticker = s.ticker AND o.trade_date = s.date ORDER BY s.date DESC, s.ticker LIMIT 100""")
    + f"SELECT {cols('ticker trade_date signal hit_tp1 hit_sl', 'next_ret_pct')} FROM o",
)
def pt_list(t):
    return outcomes.listing(_recorded(t), _resolved(t)).select("ticker", "trade_date", "signal", "hit_tp1", "hit_sl", "next_ret_pct")


@query(
    "import_legacy",
    ctes("signals", **_RES)
    + f"""SELECT s.ticker, s.date AS trade_date, s.signal, s.side, o.direction_correct, o.hit_tp1, o.hit_sl, {", ".join(f"floor(o.{x} * 1e6 + 0.5) / 1e6 AS {x}" for x in ("next_close", "next_ret_pct"))},
    false AS imported_again FROM signals s LEFT JOIN outc o ON o.ticker = s.ticker AND o.trade_date = s.date AND o.trade_date < DATE '{_CUT}'""",
)
def import_legacy(t):
    done = _known(t).select(*outcomes.OUTCOME_COLUMNS, F.lit("done").alias("resolved_at"))
    signals, results = outcomes.split_legacy(_recorded(t).join(done, outcomes.KEY, "left"))
    stored, known = (outcomes.import_if_empty(rows.limit(0), rows) for rows in (signals, results))
    # a table that holds rows takes no others
    again = outcomes.import_if_empty(signals, signals).select(*outcomes.KEY, F.lit(True).alias("_again"))
    both = stored.join(known.select(*outcomes.OUTCOME_COLUMNS), outcomes.KEY, "left").join(again, outcomes.KEY, "left")
    return both.select(
        "ticker", "trade_date", "signal", "side", "direction_correct", "hit_tp1", "hit_sl", "next_close", "next_ret_pct", F.coalesce("_again", F.lit(False)).alias("imported_again")
    )


# --- explanation ------------------------------------------------------------------

# Fixed weights stand for a fitted surrogate, so the sums can be checked in SQL.
_COEF = {"rsi": 0.02, "ret_5d": 8.0, "vol_20d": -12.0, "dist_sma_20": -6.0, "volume_ratio": 0.3, "momentum_20": 3.0, "obv_ratio_20d": 0.0}
_MEAN = {"rsi": 50.0, "ret_5d": 0.0, "vol_20d": 0.01, "dist_sma_20": 0.0, "volume_ratio": 1.0, "momentum_20": 0.0, "obv_ratio_20d": 0.0}


def _contribs(t):
    return explain.contributions(t.features.dropna(subset=list(_COEF)), _COEF, _MEAN)


_XP = {
    "mv": f"""SELECT *, greatest(coalesce(close - prev_close, 0), 0) AS g, greatest(coalesce(prev_close - close, 0), 0) AS l,
    close / lag(close, 5) OVER ({W}) - 1 AS ret_5d, close / lag(close, 20) OVER ({W}) - 1 AS momentum_20, {full(20, 'stddev_samp(ret_1d)', 'ret_1d')} AS vol_20d,
    close / {full(20, 'avg(close)', 'close')} - 1 AS dist_sma_20, volume / {full(20, 'avg(volume)', 'volume')} AS volume_ratio FROM rets""",
}


def _xp_sql():
    from barweave.plans.sqlparts import decayed

    up, dn = decayed("g", 1 / 14, "(seq - 1)"), decayed("l", 1 / 14, "(seq - 1)")
    ctes_ = {
        **_XP,
        "av": f"SELECT *, {up} AS up, {dn} AS dn FROM mv",
        "ft": "SELECT *, CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END AS rsi, 0 AS obv_ratio_20d FROM av WHERE vol_20d IS NOT NULL AND volume_ratio IS NOT NULL AND momentum_20 IS NOT NULL",
    }
    ctes_["ct"] = " UNION ALL ".join(
        f"SELECT ticker, date, '{k}' AS feature, {v!r}::DOUBLE * ({k} - {_MEAN[k]!r}::DOUBLE) AS value FROM ft" for k, v in _COEF.items()
    )
    ctes_["pr0"] = """SELECT ticker, date, sum(CASE WHEN value > 0 THEN value ELSE 0 END) AS buy_pressure, sum(CASE WHEN value < 0 THEN value ELSE 0 END) AS sell_pressure FROM ct GROUP BY 1, 2"""
    ctes_["pr"] = "SELECT *, buy_pressure + sell_pressure AS logodds, 1 / (1 + exp(-(buy_pressure + sell_pressure))) AS prob_up FROM pr0"
    return ctes_


_XPS = _xp_sql()


@query(
    "xp_top_factors",
    ctes("rets", **_XPS, rk="SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY abs(value) DESC, feature) AS pos FROM ct")
    + f"SELECT CAST(pos AS INTEGER) AS pos, {cols('ticker date feature', 'value')}, CASE WHEN value > 0 THEN 'buy' ELSE 'sell' END AS direction FROM rk WHERE pos <= 5 AND abs(value) >= 1e-4",
)
def xp_top_factors(t):
    return explain.top_factors(_contribs(t)).select("ticker", "date", "pos", "feature", "value", "direction")


@query("xp_pressure", ctes("rets", **_XPS) + f"SELECT {cols('ticker date', 'buy_pressure sell_pressure logodds prob_up')} FROM pr")
def xp_pressure(t):
    return explain.pressure(_contribs(t))


_LABELS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS feature, '{v}' AS label" for k, v in explain.LABELS.items())


@query(
    "xp_labels",
    ctes("rets", **_XPS, lb=_LABELS_SQL)
    + "SELECT feature, coalesce(label, replace(feature, '_', ' ')) AS label, count(*) AS n FROM ct LEFT JOIN lb USING (feature) GROUP BY 1, 2",
)
def xp_labels(t):
    return _contribs(t).groupBy("feature", explain.label(c("feature")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "xp_summary",
    ctes("rets", **_XPS)
    + """SELECT ticker, date, 'Bullish factors sum to ' || CAST(CAST(floor(buy_pressure * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'e-3 log-odds, bearish ones to ' ||
    CAST(CAST(floor(sell_pressure * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'e-3; P(up) is about ' || CAST(CAST(floor(prob_up * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%. ' ||
    CASE WHEN buy_pressure > abs(sell_pressure) THEN 'Momentum dominates in favour.' ELSE 'Favourable momentum is mixed with overbought or volatility pressure.' END AS summary FROM pr""",
)
def xp_summary(t):
    return explain.summary(explain.pressure(_contribs(t))).select("ticker", "date", "summary")


# --- alerts ---------------------------------------------------------------------------

_ALERT = {
    "sel": "SELECT *, date AS trade_date FROM signals WHERE signal IN ('STRONG_BUY', 'STRONG_SELL') AND trading_allowed",
    "fresh": "SELECT * FROM sel WHERE trade_date >= DATE '2000-01-01'",
    "subs": "SELECT * FROM users WHERE (trim(chat_id) <> '' OR trim(email) <> '') AND trim(tier) IN ('', 'pro')",
}


def _selected(t):
    return alerts.select(_recorded(t))


def _fresh(t):
    sent = _selected(t).where(c("trade_date") < F.lit("2000-01-01").cast("date"))
    return alerts.unsent(_selected(t), sent)


@query("al_select", ctes("signals", "users", **_ALERT) + "SELECT ticker, trade_date, signal FROM sel")
def al_select(t):
    return _selected(t).select("ticker", "trade_date", "signal")


@query("al_dedup", ctes("signals", "users", **_ALERT) + "SELECT ticker, trade_date, signal FROM fresh")
def al_dedup(t):
    return _fresh(t).select("ticker", "trade_date", "signal")


@query("al_subscribers", ctes("signals", "users", **_ALERT) + "SELECT user_id, tier FROM subs")
def al_subscribers(t):
    return alerts.subscribers(t.users).select("user_id", "tier")


@query(
    "al_fanout",
    ctes("signals", "users", **_ALERT, au="""SELECT 'chat' AS channel, count(*) FILTER (WHERE trim(chat_id) <> '') AS recipients FROM subs
    UNION ALL SELECT 'email', count(*) FILTER (WHERE trim(email) <> '') FROM subs""")
    + "SELECT ticker, trade_date, channel, recipients FROM fresh, au WHERE recipients > 0",
)
def al_fanout(t):
    return alerts.outbox(_fresh(t), t.users).select("ticker", "trade_date", "channel", "recipients")


@query(
    "al_summary",
    ctes("signals", "users", **_ALERT)
    + "SELECT (SELECT count(*) FROM fresh) * (SELECT count(*) FROM subs) AS sent, (SELECT count(*) FROM sel) - (SELECT count(*) FROM fresh) AS skipped",
)
def al_summary(t):
    return alerts.summary(_selected(t), _fresh(t), t.users)


def _cents(x):
    return f"floor({x} * 100 + 0.5) / 100"


@query(
    "al_format",
    ctes("signals", "users", **_ALERT,
         shown=f"SELECT * REPLACE ({_cents('conviction_pct')} AS conviction_pct, {_cents('entry')} AS entry, {_cents('stop_loss')} AS stop_loss, {_cents('tp1')} AS tp1, {_cents('tp2')} AS tp2) FROM fresh",
         msg="""SELECT *, CASE WHEN signal LIKE '%BUY' THEN '▲' ELSE '▼' END || ' ' || ticker || chr(10) || replace(signal, '_', ' ') || ' · conviction ' || coalesce(conviction_pct::VARCHAR, '—') || '%' || chr(10) ||
         'Entry ' || coalesce(entry::VARCHAR, '—') || ' · SL ' || coalesce(stop_loss::VARCHAR, '—') || ' · TP1 ' || coalesce(tp1::VARCHAR, '—') || ' · TP2 ' || coalesce(tp2::VARCHAR, '—') || chr(10) ||
         'R/R ' || coalesce('1:' || risk_reward::VARCHAR, '—') || ' · regime ' || regime AS body FROM shown""")
    + """SELECT ticker, trade_date, body, ticker || ' · ' || replace(signal, '_', ' ') AS subject, '<div>' || replace(body, chr(10), '<br/>') || '</div>' AS html FROM msg""",
)
def al_format(t):
    from barweave.functions.exprs import half_up

    shown = _fresh(t).withColumns({x: half_up(c(x), 2) for x in ("conviction_pct", "entry", "stop_loss", "tp1", "tp2")})
    return alerts.with_messages(shown).select("ticker", "trade_date", "body", "subject", "html")


# --- accounts --------------------------------------------------------------------------


def billing_events(t):
    """Orders as billing documents: F completes a checkout, O updates, P deletes."""
    user, status = c("o_custkey").cast("string"), c("o_orderstatus")
    kind = F.when(status == "F", "checkout.session.completed").when(status == "O", "customer.subscription.updated").otherwise("customer.subscription.deleted")
    body = F.struct(
        F.when(status == "F", user).alias("client_reference_id"),
        F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("cus_"), user)).otherwise("").alias("customer"),
        F.when(status == "F", F.concat(F.lit("sub_"), c("o_orderkey").cast("string"))).alias("subscription"),
        F.when(status != "F", F.concat(F.lit("sub_"), c("o_orderkey").cast("string"))).alias("id"),
        F.when(c("o_orderpriority").startswith("1"), "past_due").otherwise("active").alias("status"),
        F.unix_seconds(c("o_orderdate").cast("timestamp")).alias("current_period_end"),
        F.struct(user.alias("user_id")).alias("metadata"),
    )
    doc = F.to_json(F.struct(kind.alias("type"), F.struct(body.alias("object")).alias("data")))
    return t.table("orders").select(c("o_orderdate").alias("event_ts"), c("o_orderkey").alias("event_id"), doc.alias("payload"))


_BILL = {
    "ev": """SELECT o_custkey AS user_id, o_orderdate AS event_ts, o_orderkey AS event_id, CASE WHEN o_orderkey % 2 = 0 THEN 'cus_' || o_custkey END AS customer_id,
    'sub_' || o_orderkey AS subscription_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'past_due' ELSE 'active' END ELSE 'canceled' END AS status,
    CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS period_end FROM orders WHERE o_custkey > 0""",
    "sub": """SELECT user_id, arg_max(status, (event_ts, event_id)) AS status, arg_max(customer_id, (event_ts, event_id)) FILTER (WHERE customer_id IS NOT NULL) AS customer_id,
    arg_max(subscription_id, (event_ts, event_id)) AS subscription_id, arg_max(period_end, (event_ts, event_id)) FILTER (WHERE period_end IS NOT NULL) AS period_end, count(*) AS n_events FROM ev GROUP BY 1""",
}


def _subscriptions(t):
    return accounts.fold_events(accounts.parse_events(billing_events(t)))


@query(
    "ac_user_upsert",
    """WITH v AS (SELECT lower(trim(c_name)) || '@x.test' AS email FROM customer),
    e AS (SELECT lower(c_name) || '@x.test' AS email, CASE c_custkey % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'free' ELSE '' END AS tier FROM customer WHERE c_custkey % 4 = 0)
    SELECT email, split_part(email, '@', 1) AS display_name, coalesce(tier, 'free') AS tier FROM (SELECT DISTINCT email FROM v) LEFT JOIN e USING (email)""",
)
def ac_user_upsert(t):
    existing = t.users.where(c("user_id") % 4 == 0).select("email", F.lit("").alias("display_name"), "tier")
    visits = t.users.select(F.concat(F.lit("  "), F.initcap("email"), F.lit(" ")).alias("email"), F.lit("").alias("display_name"))
    return accounts.upsert_users(existing, visits)


@query(
    "ac_events_fold",
    ctes(**_BILL) + "SELECT user_id, status, customer_id, subscription_id, CAST(period_end AS DATE) AS period_end, n_events, CASE WHEN status = 'active' THEN 'pro' ELSE 'free' END AS tier FROM sub",
)
def ac_events_fold(t):
    return _subscriptions(t).select("user_id", "status", "customer_id", "subscription_id", c("period_end").cast("date").alias("period_end"), "n_events", "tier")


@query(
    "ac_status",
    ctes("users", **_BILL)
    + """SELECT user_id, email, CASE WHEN status = 'active' THEN 'pro' WHEN status IS NOT NULL THEN 'free' WHEN tier = '' THEN 'free' ELSE tier END AS tier,
    status AS subscription_status FROM users LEFT JOIN sub USING (user_id)""",
)
def ac_status(t):
    return accounts.status(t.users, _subscriptions(t)).select("user_id", "email", "tier", "subscription_status")
