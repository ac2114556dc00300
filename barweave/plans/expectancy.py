"""Queries of the expectancy study."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import expectancy as ex
from barweave.plans.registry import query
from barweave.plans.sqlparts import W, cols, ctes, full

c = F.col

# --- loading -----------------------------------------------------------------


@query(
    "ex_load_oof",
    ctes("oof", "universe")
    + """SELECT count(*) AS n_rows, count(*) FILTER (WHERE prob_up IS NULL OR target IS NULL) AS n_incomplete,
    count(*) FILTER (WHERE u.ticker IS NULL) AS n_unknown_ticker, min(date) AS first_date, max(date) AS last_date
    FROM oof LEFT JOIN (SELECT ticker FROM universe WHERE sector <> '0') u USING (ticker)""",
)
def ex_load_oof(t):
    return ex.oof_checks(t.oof, t.universe.where(c("sector") != "0"))


_BLK = {
    "num": "SELECT *, row_number() OVER (ORDER BY ticker, date) AS row_id FROM oof",
    "lagd": "SELECT *, lag(date) OVER (ORDER BY row_id) AS pd FROM num",
    "blk": "SELECT row_id, date, target, CAST(sum(CASE WHEN date < pd THEN 1 ELSE 0 END) OVER (ORDER BY row_id) AS BIGINT) AS block FROM lagd",
}


def _blocks(t):
    return t.store("blocks", lambda: ex.add_blocks(ex.number_rows(t.oof).drop("ticker")))


@query("ex_blocks", ctes("oof", **_BLK) + "SELECT row_id, date, block FROM blk")
def ex_blocks(t):
    return _blocks(t).select("row_id", "date", "block")


@query(
    "ex_block_checks",
    ctes("oof", **_BLK) + "SELECT block, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM blk GROUP BY 1",
)
def ex_block_checks(t):
    return ex.block_checks(_blocks(t))


@query(
    "ex_block_match",
    ctes(
        "oof",
        **_BLK,
        imp=f"SELECT * FROM (SELECT ticker, date, CAST(lead(close) OVER ({W}) > close AS INTEGER) AS up FROM bars) WHERE up IS NOT NULL",
        sz="SELECT block, count(*) AS n_rows FROM blk GROUP BY 1",
        sc="SELECT block, ticker, count(*) AS k, avg((up <> target)::INT) AS miss FROM blk JOIN imp USING (date) GROUP BY 1, 2",
        best="""SELECT * FROM (SELECT block, ticker, miss, row_number() OVER (PARTITION BY block ORDER BY miss, ticker) AS rn
        FROM sc JOIN sz USING (block) WHERE k >= 0.8 * n_rows) WHERE rn = 1""",
        o="SELECT block, n_rows, CASE WHEN miss <= 0.1 THEN ticker END AS ticker, coalesce(miss, 1) AS mismatch FROM sz LEFT JOIN best USING (block)",
    )
    + f"SELECT {cols('block n_rows ticker', 'mismatch')} FROM o",
)
def ex_block_match(t):
    return ex.match_blocks(_blocks(t), t.bars)


# --- execution ---------------------------------------------------------------

_ATT = {
    "trx": "SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS trs FROM rets",
    "ex0": f"SELECT *, {full(14, 'avg(trs)', 'trs')} AS atr_t, lead(open) OVER ({W}) AS entry FROM trx",
    "spy": f"SELECT date, close AS spy_t, {full(50, 'avg(close)', 'close', 'ORDER BY date')} AS spy_sma50_t FROM market",
    "att": """SELECT o.ticker, o.date, o.prob_up, o.target, o.seq AS pos_t, atr_t, x.close AS close_t, entry, v.close AS vix_t, spy_t, spy_sma50_t
    FROM oof o JOIN ex0 x USING (ticker, date) LEFT JOIN vix v USING (date) LEFT JOIN spy USING (date)""",
}
_LVL = {
    **_ATT,
    "lv0": """SELECT *, CASE WHEN prob_up >= 0.5::DOUBLE THEN 'long' ELSE 'short' END AS side, CASE WHEN prob_up >= 0.5::DOUBLE THEN 1 ELSE -1 END AS sgn,
    greatest(least(1.5::DOUBLE * atr_t / close_t, 0.05::DOUBLE), 0.01::DOUBLE) AS risk_pct, r.rr AS rr_multiple
    FROM att, (SELECT unnest([1.5::DOUBLE, 2.0::DOUBLE]) AS rr) r WHERE atr_t > 0 AND entry IS NOT NULL""",
    "lv": """SELECT *, entry - sgn * (entry * risk_pct) AS sl, entry + sgn * (rr_multiple * (entry * risk_pct)) AS tp FROM lv0""",
    "fwd": """SELECT l.*, b.seq - pos_t AS k, CASE WHEN side = 'long' THEN b.low <= sl ELSE b.high >= sl END AS hs,
    CASE WHEN side = 'long' THEN b.high >= tp ELSE b.low <= tp END AS ht, b.close AS px
    FROM lv l JOIN bars b ON b.ticker = l.ticker AND b.seq BETWEEN l.pos_t + 1 AND l.pos_t + 20""",
    "hit": """SELECT ticker, date, rr_multiple, any_value(prob_up) AS prob_up, any_value(side) AS side, any_value(pos_t) AS pos_t, any_value(entry) AS entry, any_value(sl) AS sl,
    any_value(vix_t) AS vix_t, any_value(spy_t) AS spy_t, any_value(spy_sma50_t) AS spy_sma50_t,
    min(k) FILTER (WHERE hs) AS isl, min(k) FILTER (WHERE ht) AS itp, max(k) AS n, arg_max(px, k) AS last_px FROM fwd GROUP BY 1, 2, 3""",
    "oc": """SELECT *, CASE WHEN isl IS NOT NULL AND (itp IS NULL OR isl <= itp) THEN 'sl' WHEN itp IS NOT NULL THEN 'tp' ELSE 'timeout' END AS outcome,
    0.001::DOUBLE / (abs(entry - sl) / entry) AS cost FROM hit""",
    "res": """SELECT *, CASE outcome WHEN 'sl' THEN -1 - cost WHEN 'tp' THEN rr_multiple - cost
    ELSE CASE WHEN side = 'long' THEN last_px - entry ELSE entry - last_px END / abs(entry - sl) - cost END AS r,
    CAST(CASE outcome WHEN 'sl' THEN isl WHEN 'tp' THEN itp ELSE n END AS INTEGER) AS held FROM oc""",
}
_BASE = ("rets", "oof", "vix", "market")


def _attached(t):
    return t.store("attached", lambda: ex.attach(t.oof, t.bars, t.vix, t.market))


def _resolved(t):
    return t.store("resolved", lambda: ex.resolve(_attached(t)))


@query(
    "ex_attach",
    ctes(*_BASE, **_ATT) + f"SELECT {cols('ticker date pos_t', 'atr_t close_t vix_t spy_t spy_sma50_t')} FROM att",
)
def ex_attach(t):
    return _attached(t).select("ticker", "date", "pos_t", "atr_t", "close_t", "vix_t", "spy_t", "spy_sma50_t")


_SIDE = "CASE WHEN prob_up >= {0}::DOUBLE THEN 'long' WHEN prob_up <= 1::DOUBLE - {0}::DOUBLE THEN 'short' END"


@query("ex_side", ctes("oof") + f"SELECT * FROM (SELECT ticker, date, {_SIDE.format(0.6)} AS side FROM oof) WHERE side IS NOT NULL")
def ex_side(t):
    return t.oof.select("ticker", "date", ex.side_for(c("prob_up"), 0.6).alias("side")).where(c("side").isNotNull())


@query("ex_gate_vix", ctes(*_BASE, **_ATT) + "SELECT ticker, date FROM att WHERE coalesce(vix_t, 0) <= 20")
def ex_gate_vix(t):
    return ex.gate_vix(_attached(t), 20.0).select("ticker", "date")


@query(
    "ex_gate_trend",
    ctes(*_BASE, **_ATT)
    + f"SELECT ticker, date, side FROM (SELECT *, {_SIDE.format(0.55)} AS side FROM att) WHERE side = 'short' OR (side = 'long' AND spy_t > spy_sma50_t)",
)
def ex_gate_trend(t):
    sided = _attached(t).withColumn("side", ex.side_for(c("prob_up"), 0.55)).where(c("side").isNotNull())
    return ex.gate_trend(sided).select("ticker", "date", "side")


@query("ex_entry_levels", ctes(*_BASE, **_LVL) + f"SELECT {cols('ticker date side', 'rr_multiple entry risk_pct sl tp')} FROM lv WHERE rr_multiple = 2")
def ex_entry_levels(t):
    sided = _attached(t).withColumn("side", ex.side_for(c("prob_up"), 0.5))
    return ex.entry_levels(sided, F.lit(2.0)).select("ticker", "date", "side", "rr_multiple", "entry", "risk_pct", "sl", "tp")


@query("ex_path_first_touch", ctes(*_BASE, **_LVL) + f"SELECT {cols('ticker date side outcome held', 'rr_multiple r')} FROM res")
def ex_path_first_touch(t):
    return _resolved(t).select("ticker", "date", "side", "outcome", "held", "rr_multiple", "r")


# --- portfolio limits -----------------------------------------------------------


def _final(t):
    """Long only, p ≥ 0.5, calm gauge, target at twice the risk."""
    df = _resolved(t).where((c("rr_multiple") == 2.0) & (c("side") == "long"))
    return ex.gate_vix(df, 30.0).withColumn("scenario", F.lit("final"))


_FINAL = {**_LVL, "cand": "SELECT * FROM res WHERE rr_multiple = 2 AND side = 'long' AND coalesce(vix_t, 0) <= 30"}


@query(
    "ex_one_position",
    ctes(*_BASE, **_FINAL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, chain AS (SELECT ticker, min(pos_t) AS pos_t, arg_min(held, pos_t) AS held FROM cand GROUP BY 1
    UNION ALL SELECT c.ticker, min(c.pos_t), arg_min(c.held, c.pos_t) FROM chain h JOIN cand c ON c.ticker = h.ticker AND c.pos_t > h.pos_t + h.held GROUP BY 1)
    SELECT ticker, pos_t, held FROM chain""",
)
def ex_one_position(t):
    return ex.one_position(_final(t), ["scenario"]).select("ticker", "pos_t", "held")


_STATE = "STRUCT(t VARCHAR, p BIGINT, b BIGINT, e BIGINT, d BIGINT)[]"


def limited_sql(src: str, keys: str) -> dict[str, str]:
    """CTEs folding the ordered decisions of ``src`` under the portfolio limits; ``limited`` keeps the accepted rows."""
    day = "date_diff('day', DATE '1970-01-01', date) + 1"
    return {
        "ranked": f"""SELECT {keys}, ticker AS t, pos_t AS p, pos_t + held AS b, {day} AS d,
        {day} + greatest(1, CAST(floor(held * 1.45::DOUBLE) AS BIGINT)) AS e, date FROM {src}""",
        "listed": f"""SELECT {keys}, list({{'op': [{{'t': t, 'p': p, 'b': b, 'e': e, 'd': d}}]::{_STATE}, 'taken': []::{_STATE}}} ORDER BY date, t) AS l
        FROM ranked GROUP BY {keys}""",
        "folded": f"""SELECT {keys}, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc.op, lambda o: o.e >= x.op[1].d)) < 3
        AND len(list_filter(acc.op, lambda o: o.t = x.op[1].t AND o.b >= x.op[1].p)) = 0
        THEN {{'op': list_append(list_filter(acc.op, lambda o: o.e >= x.op[1].d OR o.t <> x.op[1].t), x.op[1]), 'taken': list_append(acc.taken, x.op[1])}}
        ELSE acc END, {{'op': []::{_STATE}, 'taken': []::{_STATE}}}) AS r FROM listed""",
        "accepted": f"SELECT {keys}, unnest(r.taken).t AS ticker, unnest(r.taken).p AS pos_t FROM folded",
        "limited": f"SELECT s.* FROM {src} s JOIN accepted USING ({keys}, ticker, pos_t)",
    }


_FINAL_S = {**_FINAL, "cands": "SELECT *, 'final' AS scenario FROM cand"}


@query(
    "ex_max_concurrent",
    ctes(*_BASE, **_FINAL_S, **limited_sql("cands", "scenario")) + f"SELECT {cols('date ticker pos_t held', 'r')} FROM limited",
)
def ex_max_concurrent(t):
    return ex.max_concurrent(_final(t), ["scenario"], limit=3).select("date", "ticker", "pos_t", "held", "r")


# --- measures --------------------------------------------------------------------


def metrics_sql(src: str, keys: str) -> dict[str, str]:
    part = f"PARTITION BY {keys} " if keys else ""
    return {
        "eq": f"SELECT *, product(1 + 0.01::DOUBLE * r) OVER ({part}ORDER BY date, ticker) AS equity FROM {src}",
        "pk": f"SELECT *, greatest(1, max(equity) OVER ({part}ORDER BY date, ticker)) AS peak FROM eq",
        "ma": f"""SELECT {keys + ', ' if keys else ''}count(*) AS n_trades, avg((r > 0)::INT) AS win_rate,
        sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(sum(CASE WHEN r <= 0 THEN -r ELSE 0 END), 0) AS profit_factor, avg(r) AS expectancy_r,
        (product(1 + 0.01::DOUBLE * r) - 1) * 100 AS total_return_pct, least(0, min((equity - peak) / peak)) * 100 AS max_drawdown_pct,
        avg(0.01::DOUBLE * r) AS mu, stddev_pop(0.01::DOUBLE * r) AS sd, avg(held) AS avg_hold_days,
        greatest(date_diff('day', min(date), max(date)) / 365.25::DOUBLE, 1e-9::DOUBLE) AS years FROM pk {'GROUP BY ' + keys if keys else ''}""",
        "me": "SELECT *, CASE WHEN sd > 0 THEN mu / sd * sqrt(n_trades / years) ELSE 0 END AS sharpe FROM ma",
    }


MEASURES = "win_rate profit_factor expectancy_r total_return_pct max_drawdown_pct sharpe avg_hold_days"
_GATED = f"SELECT * FROM (SELECT *, {_SIDE.format('p.prob_min')} AS s2 FROM res, (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in ex.SWEEP_PROBS)}]) AS prob_min) p) WHERE s2 IS NOT NULL"


def _main(t):
    return ex.into_scenarios(_resolved(t).where(c("rr_multiple") == 2.0), [0.60])


_MAIN = {**_LVL, "main": f"SELECT * FROM (SELECT *, {_SIDE.format(0.6)} AS s2 FROM res WHERE rr_multiple = 2) WHERE s2 IS NOT NULL"}


@query("ex_equity", ctes(*_BASE, **_MAIN, **metrics_sql("main", "")) + f"SELECT {cols('date ticker', 'equity')} FROM eq")
def ex_equity(t):
    return ex.equity(_main(t), []).select("date", "ticker", "equity")


@query("ex_metrics", ctes(*_BASE, **_MAIN, **metrics_sql("main", "")) + f"SELECT {cols('n_trades', MEASURES)} FROM me")
def ex_metrics(t):
    return ex.metrics(_main(t), [])


@query(
    "ex_per_side",
    ctes(*_BASE, **_MAIN, o="""SELECT side, count(*) AS n, avg((r > 0)::INT) AS win_rate, avg(r) AS expectancy_r, count(*) FILTER (WHERE outcome = 'tp') AS n_tp,
    count(*) FILTER (WHERE outcome = 'sl') AS n_sl, count(*) FILTER (WHERE outcome = 'timeout') AS n_timeout FROM main GROUP BY 1""")
    + f"SELECT {cols('side n n_tp n_sl n_timeout', 'win_rate expectancy_r')} FROM o",
)
def ex_per_side(t):
    return ex.per_side(_main(t), [])


@query(
    "ex_sweep",
    ctes(*_BASE, **_LVL, gated=_GATED, **metrics_sql("gated", "prob_min, rr_multiple")) + f"SELECT {cols('n_trades', 'prob_min rr_multiple ' + MEASURES)} FROM me",
)
def ex_sweep(t):
    return ex.metrics(ex.into_scenarios(_resolved(t)), ["prob_min", "rr_multiple"])


@query(
    "ex_per_year",
    ctes(*_BASE, **_FINAL, y="SELECT *, CAST(year(date) AS INTEGER) AS year FROM cand", **limited_sql("y", "year"), **metrics_sql("limited", "year"))
    + f"SELECT {cols('year n_trades', MEASURES)} FROM me",
)
def ex_per_year(t):
    """Each year on its own, under the portfolio limits."""
    rows = _final(t).drop("scenario").withColumn("year", F.year("date"))
    return ex.metrics(ex.max_concurrent(rows, ["year"], limit=3), ["year"])


def _sector(t, rows):
    """Rows with the sector of their ticker."""
    labelled = rows.join(t.universe.select("ticker", "sector"), "ticker", "left")
    return labelled.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


_SECTOR_SQL = "SELECT m.*, coalesce(sector, 'Unknown') AS sector FROM {} m LEFT JOIN universe USING (ticker)"


@query(
    "ex_per_sector",
    ctes(*_BASE, "universe", **_FINAL, y=_SECTOR_SQL.format("cand"), **limited_sql("y", "sector"), **metrics_sql("limited", "sector"),
         scored=_SECTOR_SQL.format("oof"), tk="SELECT sector, count(DISTINCT ticker) AS n_tickers FROM scored GROUP BY 1")
    + f"SELECT {cols('sector n_trades n_tickers', MEASURES)} FROM me JOIN tk USING (sector) WHERE n_trades >= 30",
)
def ex_per_sector(t):
    """Each sector on its own, under the portfolio limits; tickers are those that were scored."""
    rows = _sector(t, _final(t).drop("scenario"))
    tickers = _sector(t, t.oof).select("sector", "ticker").distinct().groupBy("sector").agg(F.count(F.lit(1)).alias("n_tickers"))
    return ex.metrics(ex.max_concurrent(rows, ["sector"], limit=3), ["sector"]).where(c("n_trades") >= 30).join(tickers, "sector")


def _sensitivity(t):
    """Decisions under each gate configuration: everything, long only, long only with a calm gauge."""
    long = c("side") == "long"
    calm = F.coalesce("vix_t", F.lit(0.0)) <= 30.0
    configs = F.array(F.lit("all"), F.when(long, "long"), F.when(long & calm, "long, calm"))
    base = _resolved(t).where(c("rr_multiple") == 2.0)
    return base.withColumn("config", F.explode(F.array_compact(configs)))


_SENS_SQL = {
    **_LVL,
    "sens": """SELECT *, 'all' AS config FROM res WHERE rr_multiple = 2 UNION ALL SELECT *, 'long' FROM res WHERE rr_multiple = 2 AND side = 'long'
    UNION ALL SELECT *, 'long, calm' FROM res WHERE rr_multiple = 2 AND side = 'long' AND coalesce(vix_t, 0) <= 30""",
}


@query(
    "ex_sensitivity",
    ctes(*_BASE, **_SENS_SQL, **limited_sql("sens", "config"), **metrics_sql("limited", "config"), o="SELECT *, n_trades AS n FROM me")
    + f"SELECT {cols('config n', 'win_rate profit_factor expectancy_r')} FROM o",
)
def ex_sensitivity(t):
    """The gate configurations compared, each under the portfolio limits."""
    limited = ex.max_concurrent(_sensitivity(t), ["config"], limit=3)
    return ex.metrics(limited, ["config"]).select("config", c("n_trades").alias("n"), "win_rate", "profit_factor", "expectancy_r")


@query(
    "ex_sensitivity_limited",
    ctes(*_BASE, **_SENS_SQL, **limited_sql("sens", "config"), **metrics_sql("limited", "config")) + f"SELECT {cols('config n_trades', MEASURES)} FROM me",
)
def ex_sensitivity_limited(t):
    """The same configurations with all measures."""
    return ex.metrics(ex.max_concurrent(_sensitivity(t), ["config"], limit=3), ["config"])


@query(
    "ex_benchmark",
    ctes("oof", "market", rng="SELECT min(date) AS d0, max(date) AS d1 FROM oof",
         h="SELECT m.*, date_diff('day', d0, d1) / 365.25::DOUBLE AS years FROM market m, rng WHERE date BETWEEN d0 AND d1",
         n="SELECT *, close / first_value(close) OVER (ORDER BY date) AS norm, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM h",
         d="SELECT *, norm / max(norm) OVER (ORDER BY date) - 1 AS dd FROM n",
         o="""SELECT count(*) AS n, (arg_max(norm, date) - 1) * 100 AS total_return_pct, (pow(arg_max(norm, date), 1 / max(years)) - 1) * 100 AS cagr_pct,
         min(dd) * 100 AS max_drawdown_pct, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM d HAVING count(*) > 50""")
    + f"SELECT {cols('n', 'total_return_pct cagr_pct max_drawdown_pct sharpe')} FROM o",
)
def ex_benchmark(t):
    return ex.benchmark(t.market, t.oof.agg(F.min("date")).scalar(), t.oof.agg(F.max("date")).scalar())


_STUDY = {
    **_FINAL,
    "grouped": """SELECT c.*, sector, CASE WHEN sector = '0' THEN 'control' ELSE 'universe' END AS grp FROM cand c JOIN universe USING (ticker)""",
    "sliced": """SELECT *, 'all' AS slice FROM grouped UNION ALL SELECT *, CAST(year(date) AS VARCHAR) FROM grouped
    UNION ALL SELECT *, 'sector ' || sector FROM grouped WHERE grp = 'universe'""",
}


@query(
    "ex_study",
    ctes(*_BASE, "universe", **_STUDY, **limited_sql("sliced", "grp, slice"), **metrics_sql("limited", "grp, slice"))
    + f"SELECT {cols('grp slice n_trades', MEASURES)} FROM me WHERE NOT starts_with(slice, 'sector ') OR n_trades >= 30",
)
def ex_study(t):
    """Portfolio-limited results of the universe and of the training tickers: in all, by year, and by sector with enough trades."""
    held = t.universe.where(c("sector") == "0").select("ticker")  # stands for the training tickers
    base = _final(t).drop("scenario")
    outside = base.join(held, "ticker", "left_anti").withColumn("grp", F.lit("universe"))
    control = base.join(held, "ticker", "left_semi").withColumn("grp", F.lit("control"))
    rows = outside.unionByName(control).join(t.universe.select("ticker", "sector"), "ticker")
    sector = F.when(c("grp") == "universe", F.concat(F.lit("sector "), c("sector")))
    slices = F.array_compact(F.array(F.lit("all"), F.year("date").cast("string"), sector))
    limited = ex.max_concurrent(rows.withColumn("slice", F.explode(slices)), ["grp", "slice"], limit=3)
    measured = ex.metrics(limited, ["grp", "slice"])
    return measured.where(~c("slice").startswith("sector ") | (c("n_trades") >= 30))


@query(
    "sink_study_json",
    ctes(*_BASE, **_MAIN, **metrics_sql("main", ""), nn="SELECT *, row_number() OVER (ORDER BY date, ticker) AS seq, count(*) OVER () AS total FROM eq")
    + f"SELECT {cols('seq date ticker', 'equity')} FROM nn WHERE seq % greatest(1, (total + 1) // 400) = 0",
)
def sink_study_json(t):
    return ex.thin_equity(ex.equity(_main(t), []), []).select("seq", "date", "ticker", "equity")
