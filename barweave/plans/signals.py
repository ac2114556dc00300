"""Queries over regimes, price levels, signals, the screener and the stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave import panel
from barweave.operators import levels, regime, screener, signals, store
from barweave.operators.features import layered
from barweave.plans.features import _COMPLETE
from barweave.plans.registry import query
from barweave.plans.sqlparts import W, cols, ctes

c = F.col

# --- regime -------------------------------------------------------------------


@query("rg_atr_sma", ctes("atrs") + f"SELECT {cols('ticker date', 'atr_sma')} FROM atrs")
def rg_atr_sma(t):
    return panel.windowed(t.bars, [layered(regime.simple_atr)], back=16).select("ticker", "date", "atr_sma")


def _measures(t):
    return panel.windowed(t.bars, [layered(regime.range_and_gap)], back=16)


@query("rg_range_atr", ctes("reg0") + f"SELECT {cols('ticker date', 'range_atr')}, coalesce(range_atr >= 3, false) AS is_caution FROM reg0")
def rg_range_atr(t):
    flag = F.coalesce(c("range_atr") >= regime.RANGE_ATR_CAUTION, F.lit(False))
    return _measures(t).select("ticker", "date", "range_atr", flag.alias("is_caution"))


@query(
    "rg_gap_atr",
    ctes("reg0")
    + f"SELECT {cols('ticker date', 'gap_atr')}, CASE WHEN gap_atr >= 2.5 THEN 'suspend' WHEN gap_atr >= 1.5 THEN 'caution' ELSE 'none' END AS action FROM reg0",
)
def rg_gap_atr(t):
    action = (
        F.when(c("gap_atr") >= regime.GAP_ATR_SUSPEND, "suspend").when(c("gap_atr") >= regime.GAP_ATR_CAUTION, "caution")
        .otherwise("none")
    )
    return _measures(t).select("ticker", "date", "gap_atr", action.alias("action"))


@query("rg_vix_asof", ctes("reg0") + f"SELECT {cols('ticker date', 'vix_level')} FROM reg0")
def rg_vix_asof(t):
    return regime.join_vix_asof(t.bars, t.vix).select("ticker", "date", "vix_level")


@query("rg_vix_z", ctes("reg0") + f"SELECT {cols('ticker date', 'vix_z')} FROM reg0")
def rg_vix_z(t):
    return regime.join_vix_asof(t.bars, t.vix).select("ticker", "date", "vix_z")


@query("rg_status", ctes("reg2") + f"SELECT {cols('ticker date status trading_allowed', 'position_scale')} FROM reg2")
def rg_status(t):
    return regime.regimes(t.bars, t.vix).select("ticker", "date", "status", "trading_allowed", "position_scale")


def _t1(x: str) -> str:
    return f"CAST(floor({x} * 10 + 0.5) / 10 AS VARCHAR)"


_VT = f"{_t1('vix_level')} || coalesce(', z=' || {_t1('vix_z')}, '')"
_GS = "coalesce(gap_atr >= 2.5, false)"


@query(
    "rg_reasons",
    ctes("reg2", r=f"""SELECT ticker, date, CASE WHEN seq < 20 THEN ['short history (<20 bars)'] WHEN status = 'normal' THEN ['normal conditions']
    ELSE list_filter([CASE WHEN range_atr >= 3 THEN 'day range ' || {_t1('range_atr')} || 'x ATR' END,
    CASE WHEN {_GS} THEN 'opening gap ' || {_t1('gap_atr')} || 'x ATR, above the stop level' WHEN gap_atr >= 1.5 THEN 'opening gap ' || {_t1('gap_atr')} || 'x ATR' END,
    CASE WHEN NOT {_GS} AND (vix_level >= 35 OR vix_z >= 3) THEN 'volatility panic (' || {_VT} || ')'
         WHEN NOT {_GS} AND (vix_level >= 25 OR vix_z >= 1.8) THEN 'volatility elevated (' || {_VT} || ')' END], lambda x: x IS NOT NULL) END AS reasons FROM reg2""")
    + "SELECT ticker, date, CAST(len(reasons) AS INTEGER) AS n_reasons, array_to_string(reasons, '; ') AS reasons FROM r",
)
def rg_reasons(t):
    out = regime.add_reasons(regime.regimes(t.bars, t.vix))
    return out.select("ticker", "date", F.size("reasons").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons"))


@query(
    "rg_as_of",
    ctes("reg2", r=f"SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM reg2 WHERE date <= DATE '1999-06-30'")
    + f"SELECT {cols('ticker date status', 'position_scale gap_atr')} FROM r WHERE k = 1",
)
def rg_as_of(t):
    return regime.as_of(t.bars, t.vix, "1999-06-30").select("ticker", "date", "status", "position_scale", "gap_atr")


@query(
    "rg_vol_tercile",
    ctes("rets", v=f"SELECT *, CASE WHEN count(ret_1d) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN stddev_samp(ret_1d) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS realized_vol FROM rets",
         q="SELECT ticker, quantile_cont(realized_vol, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM v GROUP BY 1")
    + f"SELECT {cols('ticker date', 'realized_vol')}, CASE WHEN realized_vol <= q[1] THEN 'low' WHEN realized_vol <= q[2] THEN 'mid' WHEN realized_vol > q[2] THEN 'high' END AS vol_regime FROM v JOIN q USING (ticker)",
)
def rg_vol_tercile(t):
    return t.terciles.select("ticker", "date", "realized_vol", "vol_regime")


# --- signals ------------------------------------------------------------------

_GRADE = """CASE WHEN prob_up >= 0.55::DOUBLE THEN 'STRONG_BUY' WHEN prob_up >= 0.5::DOUBLE THEN 'BUY'
WHEN prob_up <= 1::DOUBLE - 0.55::DOUBLE THEN 'STRONG_SELL' ELSE 'SELL' END"""


@query("sg_classify", ctes("bars") + f"SELECT ticker, date, {_GRADE} AS signal, CASE WHEN prob_up >= 0.5 THEN 'long' ELSE 'short' END AS side FROM bars")
def sg_classify(t):
    return signals.add_grade(t.bars).select("ticker", "date", "signal", "side")


@query(
    "sg_conviction",
    ctes("bars", o="SELECT ticker, date, abs(prob_up - 0.5) * 200 AS conviction_pct, greatest(prob_up, 1 - prob_up) * 100 AS confidence_pct FROM bars")
    + f"SELECT {cols('ticker date', 'conviction_pct confidence_pct')} FROM o",
)
def sg_conviction(t):
    return signals.add_grade(t.bars).select("ticker", "date", "conviction_pct", "confidence_pct")


_F11 = f"({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_PIV = {
    "win": f"""SELECT *, count(*) OVER {_F11} AS k, max(high) OVER {_F11} AS mx, min(low) OVER {_F11} AS mn,
    list(high) OVER {_F11} AS hs, list(low) OVER {_F11} AS ls FROM bars""",
    "piv": """SELECT ticker, date, high, low, k = 11 AND high = mx AND len(list_filter(hs, lambda x: x < high)) >= 5 AS pivot_high,
    k = 11 AND low = mn AND len(list_filter(ls, lambda x: x > low)) >= 5 AS pivot_low FROM win""",
}
_ZONE = {
    **_PIV,
    "pp": """SELECT ticker, 'support' AS kind, low AS price FROM piv WHERE pivot_low
    UNION ALL SELECT ticker, 'resistance', high FROM piv WHERE pivot_high""",
    "gaps": "SELECT *, lag(price) OVER (PARTITION BY ticker, kind ORDER BY price) AS prev FROM pp",
    "zn": """SELECT *, sum(CASE WHEN abs(price - prev) / prev <= 0.01 THEN 0 ELSE 1 END)
    OVER (PARTITION BY ticker, kind ORDER BY price ROWS UNBOUNDED PRECEDING) AS zone FROM gaps""",
    "zones": """SELECT ticker, kind, CAST(zone AS BIGINT) AS zone, avg(price) AS level, count(*) AS n_pivots FROM zn GROUP BY 1, 2, 3""",
}


@query("sg_pivots", ctes("bars", **_PIV) + "SELECT ticker, date, pivot_high, pivot_low FROM piv")
def sg_pivots(t):
    return levels.pivots(t.bars).select("ticker", "date", "pivot_high", "pivot_low")


@query("sg_cluster_zones", ctes("bars", **_ZONE) + f"SELECT {cols('ticker kind zone n_pivots', 'level')} FROM zones")
def sg_cluster_zones(t):
    return levels.zones(levels.pivots(t.bars))


_R2 = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_BUILD = {
    **_ZONE,
    "zs": """SELECT ticker, list_sort(coalesce(list(level) FILTER (WHERE kind = 'support'), [])) AS supports,
    list_sort(coalesce(list(level) FILTER (WHERE kind = 'resistance'), [])) AS resistances FROM zones GROUP BY 1""",
    "now": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM graded) WHERE k = 1",
    "b0": """SELECT n.*, coalesce(supports, []) AS supports, coalesce(resistances, []) AS resistances, close AS price,
    CASE WHEN atr > 0 THEN atr WHEN seq > 20 AND atr_sma > 0 THEN atr_sma END AS a FROM now n LEFT JOIN zs USING (ticker)""",
    "b1": """SELECT *, CASE WHEN a IS NOT NULL THEN price END AS entry, CASE WHEN sgn = 1
    THEN coalesce(list_max(list_filter(supports, lambda x: x < price)) - 0.5 * a, price - 1.5 * a)
    ELSE coalesce(list_min(list_filter(resistances, lambda x: x > price)) + 0.5 * a, price + 1.5 * a) END AS stop_loss FROM b0""",
    "b2": "SELECT *, abs(entry - stop_loss) AS risk, CASE WHEN sgn = 1 THEN resistances ELSE supports END AS walls FROM b1",
    "b3": """SELECT *, entry + sgn * greatest(a, risk) AS tp1_raw, entry + sgn * greatest(2 * a, 2 * risk) AS tp2_raw FROM b2""",
    "b4": """SELECT *, list_filter(walls, lambda x: sgn * (x - entry) > 0 AND sgn * (x - entry) < sgn * (tp1_raw - entry)) AS w1,
    list_filter(walls, lambda x: sgn * (x - entry) > 0 AND sgn * (x - entry) < sgn * (tp2_raw - entry)) AS w2 FROM b3""",
    "b5": """SELECT *, CASE WHEN sgn = 1 THEN list_max(w1) ELSE list_min(w1) END AS tp1_cap,
    CASE WHEN sgn = 1 THEN list_min(w2) ELSE list_max(w2) END AS tp2_wall FROM b4""",
    "b6": f"""SELECT *, coalesce(tp1_cap, tp1_raw) AS tp1_level, {_R2('coalesce(tp1_cap, tp1_raw)')} AS p1, {_R2('tp2_raw')} AS p2 FROM b5""",
    "b7": """SELECT *, p1 = p2 AS same, CASE WHEN p1 = p2 THEN tp1_level ELSE tp2_raw END AS last_level,
    abs(p2 - entry) / nullif(risk, 0) AS rr0 FROM b6""",
    "b8": """SELECT *, coalesce(rr0 + 1e-9 < 2, false) AS rr_forced, CASE WHEN rr0 + 1e-9 < 2 THEN entry + sgn * 2 * risk ELSE last_level END AS end_level,
    CASE WHEN rr0 + 1e-9 < 2 THEN 2 ELSE rr0 END AS risk_reward, least(100, 0.01 / nullif(risk / entry, 0) * 100) AS base_size_pct FROM b7""",
    "b9": "SELECT *, base_size_pct * position_scale AS position_size_pct, a / price * 100 AS atr_pct, status AS regime FROM b8",
}


def _built(t):
    return t.store("built", lambda: signals.build(t.bars, t.vix))


def built(name: str, plain: str, doubles: str, renames: str = "*"):
    sql = ctes("graded", **_BUILD) + f"SELECT {cols('ticker date ' + plain, doubles)} FROM (SELECT {renames} FROM b9)"

    @query(name, sql)
    def build(t):
        return _built(t).select("ticker", "date", *plain.split(), *doubles.split())


built("sg_stop", "side", "price stop_loss")
built("sg_targets", "side", "risk tp1_raw tp2_raw")
built("sg_tp1_cap", "", "tp1_raw tp1_cap tp1_level")
built("sg_tp2_note", "", "tp2_raw tp2_wall")
built("sg_rr_enforce", "rr_forced", "risk_reward")
built("sg_size", "", "base_size_pct")


@query(
    "sg_regime_scale",
    ctes("graded", **_BUILD)
    + f"""SELECT {cols('ticker date status trading_allowed', 'base_size_pct position_size_pct')},
    CASE status WHEN 'suspended' THEN 'regime suspended: signal shown but not tradable' WHEN 'caution' THEN 'regime caution: size halved' END AS regime_note FROM b9""",
)
def sg_regime_scale(t):
    return _built(t).select("ticker", "date", "status", "trading_allowed", "base_size_pct", "position_size_pct", "regime_note")


@query(
    "sg_tp_pack",
    ctes("graded", **_BUILD, tp="""SELECT ticker, 1 AS pos, 'TP1' AS name, p1 AS price, sgn * (tp1_level - entry) / entry * 100 AS move_pct, abs(tp1_level - entry) / risk AS rr
    FROM b9 WHERE NOT same UNION ALL SELECT ticker, CASE WHEN same THEN 1 ELSE 2 END, CASE WHEN same THEN 'TP1' ELSE 'TP2' END,
    """ + _R2("end_level") + """, sgn * (end_level - entry) / entry * 100, CASE WHEN rr_forced THEN 2 ELSE abs(end_level - entry) / risk END FROM b9 WHERE entry IS NOT NULL""")
    + f"SELECT ticker, CAST(pos AS INTEGER) AS pos, {cols('name', 'price move_pct rr')} FROM tp",
)
def sg_tp_pack(t):
    return _built(t).select("ticker", F.posexplode("take_profits").alias("pos", "tp")).select(
        "ticker", (c("pos") + 1).alias("pos"), "tp.name", "tp.price", "tp.move_pct", "tp.rr"
    )


_NOTES = """list_filter([CASE WHEN tp1_cap IS NOT NULL THEN 'TP1 capped by a price level' END,
CASE WHEN tp2_wall IS NOT NULL THEN 'a price level lies before TP2; reward/risk takes precedence' END,
CASE status WHEN 'suspended' THEN 'regime suspended: signal shown but not tradable' WHEN 'caution' THEN 'regime caution: size halved' END], lambda x: x IS NOT NULL)"""


@query(
    "sg_build",
    ctes("graded", **_BUILD)
    + f"""SELECT {cols('ticker date signal side status trading_allowed', 'confidence_pct conviction_pct prob_up price atr_pct entry stop_loss risk_reward position_size_pct')},
    array_to_string({_NOTES}, '; ') AS notes FROM b9""",
)
def sg_build(t):
    return _built(t).select(
        "ticker", "date", "signal", "side", "status", "trading_allowed", "confidence_pct", "conviction_pct", "prob_up", "price",
        "atr_pct", "entry", "stop_loss", "risk_reward", "position_size_pct", F.array_join("notes", "; ").alias("notes"),
    )


@query(
    "sg_levels_output",
    ctes("graded", **_BUILD, o="""SELECT ticker, 'support' AS kind, unnest(supports[-4:]) AS level FROM b9
    UNION ALL SELECT ticker, 'resistance', unnest(resistances[-4:]) FROM b9""")
    + f"SELECT {cols('ticker kind', 'level')} FROM o",
)
def sg_levels_output(t):
    return _exploded(_built(t), c("supports"), c("resistances"))


def _exploded(df, supports, resistances):
    kinds = F.create_map(F.lit("support"), supports, F.lit("resistance"), resistances)
    return df.select("ticker", F.explode(kinds).alias("kind", "ls")).select("ticker", "kind", F.explode("ls").alias("level"))


@query(
    "sg_nearest_levels",
    ctes("graded", **_BUILD, o="""SELECT ticker, price, 'support' AS kind, unnest(supports) AS level FROM b9
    UNION ALL SELECT ticker, price, 'resistance', unnest(resistances) FROM b9""",
    k="SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY abs(level - price), level) AS rn FROM o")
    + f"SELECT {cols('ticker kind', 'level')} FROM k WHERE rn <= 4",
)
def sg_nearest_levels(t):
    return _exploded(
        _built(t), levels.nearest(c("all_supports"), c("price")), levels.nearest(c("all_resistances"), c("price"))
    )


@query("sg_levels_invalid", ctes("signals") + f"SELECT {cols('ticker date', 'atr entry stop_loss position_size_pct')} FROM signals")
def sg_levels_invalid(t):
    return t.signals.select("ticker", "date", "atr", "entry", "stop_loss", "position_size_pct")


# --- screener -----------------------------------------------------------------

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM signals) WHERE k = 1"
_SCAN_COLS = ("ticker date signal side regime trading_allowed", "confidence_pct conviction_pct prob_up price atr_pct entry stop_loss tp1 tp2 position_size_pct volume_ratio rsi")
# the test tables' gauge ends before their bars: the scan is of the day it ends
_SCANNED = {
    "latest": _LATEST.replace("FROM signals", "FROM signals WHERE date <= (SELECT max(date) FROM vix)"),
    "complete": _COMPLETE,
    "s": "SELECT l.*, f.rsi FROM latest l JOIN complete f ON f.ticker = l.ticker AND f.date = l.date WHERE l.entry IS NOT NULL",
}


def _scan(t):
    return screener.scan(t.signals.where(c("date") <= t.vix.agg(F.max("date")).scalar()), t.features)


@query("scr_scan", ctes("signals", "vix", **_SCANNED) + f"SELECT {cols(*_SCAN_COLS)} FROM s")
def scr_scan(t):
    return _scan(t).select(*_SCAN_COLS[0].split(), *_SCAN_COLS[1].split())


@query(
    "scr_filters",
    ctes("signals", "universe", "vix", **_SCANNED)
    + f"""SELECT {cols('ticker date signal', 'confidence_pct conviction_pct atr_pct volume_ratio')} FROM s
    WHERE side = 'long' AND confidence_pct >= 52 AND conviction_pct >= 5 AND atr_pct <= 4 AND volume_ratio >= 0.8 AND trading_allowed
    AND ticker IN (SELECT ticker FROM universe WHERE sector = '2' OR sector = '3') AND upper(ticker) IN ('BRAND#2', 'BRAND#3', 'BRAND#12', 'BRAND#13', 'BRAND#4')""",
)
def scr_filters(t):
    wanted = t.universe.where(c("sector").isin("2", "3"))
    return screener.matching(
        _scan(t), side="long", min_confidence=52, min_conviction=5, max_atr_pct=4, min_volume_ratio=0.8, members=wanted,
        watchlist=["Brand#2", "Brand#3", "Brand#12", "Brand#13", "Brand#4"], only_tradable=True,
    ).select("ticker", "date", "signal", "confidence_pct", "conviction_pct", "atr_pct", "volume_ratio")


@query(
    "scr_counts",
    ctes("signals", "vix", **_SCANNED)
    + """SELECT count(*) AS total, count(*) FILTER (WHERE side = 'long') AS buy_count, count(*) FILTER (WHERE side = 'short') AS sell_count,
    count(*) FILTER (WHERE NOT trading_allowed) AS suspended_count FROM s""",
)
def scr_counts(t):
    return screener.counts(_scan(t))


@query(
    "scr_top",
    ctes("signals", "vix", **_SCANNED) + f"SELECT {cols('ticker signal', 'conviction_pct')} FROM s WHERE trading_allowed ORDER BY conviction_pct DESC, ticker LIMIT 10",
)
def scr_top(t):
    return screener.top(_scan(t), 10).select("ticker", "signal", "conviction_pct")


_WL_SQL = """SELECT 'wl' || c_custkey AS name, c_custkey AS user_id,
[' brand#' || (c_custkey % 25 + 1), 'BRAND#' || (c_custkey % 7 + 1), 'brand#' || (c_custkey % 25 + 1)] AS raw FROM customer"""
_WL = {
    "wl": _WL_SQL,
    "lists": "SELECT name, user_id, list_sort(list_distinct(list_transform(raw, lambda x: upper(trim(x))))) AS tickers FROM wl",
}


def _raw_lists(t):
    k = c("c_custkey")
    text = lambda p, n: F.concat(F.lit(p), (k % n + 1).cast("string"))
    return t.table("customer").select(
        F.concat(F.lit("wl"), k.cast("string")).alias("name"), k.alias("user_id"),
        F.array(text(" brand#", 25), text("BRAND#", 7), text("brand#", 25)).alias("tickers"),
    )


def _lists(t):
    return store.create_lists(_raw_lists(t))


@query(
    "scr_priority_queue",
    ctes("universe", **_WL, want="SELECT DISTINCT t.t AS ticker FROM (SELECT unnest(tickers) AS t FROM lists WHERE user_id % 3 = 0) t")
    + """SELECT u.ticker, w.ticker IS NOT NULL AS prioritised, row_number() OVER (ORDER BY CASE WHEN w.ticker IS NULL THEN 1 ELSE 0 END, u.ticker) AS position
    FROM universe u LEFT JOIN want w ON w.ticker = upper(u.ticker)""",
)
def scr_priority_queue(t):
    mine = _lists(t).where(c("user_id") % 3 == 0)
    return screener.priority_queue(t.universe, mine)


@query(
    "scr_public_columns",
    ctes("signals", s=_LATEST)
    + f"SELECT {cols('ticker date signal side regime trading_allowed', 'prob_up confidence_pct conviction_pct entry stop_loss risk_reward position_size_pct price atr_pct volume_ratio')} FROM s WHERE entry IS NOT NULL AND volume_ratio IS NOT NULL ORDER BY conviction_pct DESC, ticker LIMIT 50",
)
def scr_public_columns(t):
    return screener.public_view(_scan(t))


# --- signal store ---------------------------------------------------------------
# Two overlapping batches of the history: the second re-scores its dates.

_BATCH = {
    "log": """SELECT 1 AS batch_id, upper(ticker) AS ticker, date AS trade_date, * EXCLUDE (ticker, date) FROM signals WHERE date < DATE '2000-01-01'
    UNION ALL SELECT 2, upper(ticker), date, * EXCLUDE (ticker, date) REPLACE (least(conviction_pct + 1, 100) AS conviction_pct) FROM signals WHERE date >= DATE '1999-01-01'""",
    "st": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY batch_id DESC) AS k FROM log) WHERE k = 1",
}


def _log(t):
    s = t.signals.withColumnRenamed("date", "trade_date")
    first = store.to_log(s.where(c("trade_date") < F.lit("2000-01-01").cast("date")), 1)
    again = s.where(c("trade_date") >= F.lit("1999-01-01").cast("date"))
    again = again.withColumn("conviction_pct", F.least(c("conviction_pct") + 1, F.lit(100.0)))
    return first.unionByName(store.to_log(again, 2))


def _store(t):
    return store.current(_log(t))


@query("st_upsert", ctes("signals", **_BATCH) + f"SELECT CAST(batch_id AS INTEGER) AS batch_id, {cols('ticker trade_date signal regime', 'conviction_pct tp1 tp2')} FROM st")
def st_upsert(t):
    return _store(t).select("batch_id", "ticker", "trade_date", "signal", "regime", "conviction_pct", "tp1", "tp2")


@query(
    "st_latest",
    ctes("signals", **_BATCH)
    + f"""SELECT {cols('ticker trade_date signal side', 'confidence_pct conviction_pct')} FROM st WHERE trade_date = (SELECT max(trade_date) FROM st)
    AND trading_allowed AND side = 'long' AND signal IN ('STRONG_BUY', 'BUY') AND coalesce(confidence_pct, 0) >= 50 ORDER BY conviction_pct DESC, ticker LIMIT 50""",
)
def st_latest(t):
    return store.latest(_store(t), only_tradable=True, side="buy", signals=["strong buy", "BUY"], min_confidence=50).select(
        "ticker", "trade_date", "signal", "side", "confidence_pct", "conviction_pct"
    )


@query(
    "st_history",
    ctes("signals", **_BATCH) + f"SELECT {cols('ticker trade_date signal', 'conviction_pct')} FROM st WHERE ticker = 'BRAND#12' ORDER BY trade_date DESC LIMIT 30",
)
def st_history(t):
    return store.history(_store(t), "brand#12", 30).select("ticker", "trade_date", "signal", "conviction_pct")


@query("st_count", ctes("signals", **_BATCH) + "SELECT count(*) AS n FROM st")
def st_count(t):
    return _store(t).agg(F.count(F.lit(1)).alias("n"))


@query(
    "st_json_clean",
    ctes("signals", o="SELECT ticker, date, [CASE WHEN isfinite(tp1) THEN tp1 END, CASE WHEN isfinite(tp2) THEN tp2 END] AS t, CASE WHEN isfinite(entry) THEN entry END AS entry FROM signals")
    + f"SELECT {cols('ticker date', 'entry')}, CAST(len(list_filter(t, lambda x: x IS NOT NULL)) AS INTEGER) AS n_targets FROM o",
)
def st_json_clean(t):
    doc = F.struct("entry", F.array("tp1", "tp2").alias("targets"))
    back = F.from_json(store.clean_json(doc), "entry double, targets array<double>")
    return t.signals.select("ticker", "date", back.alias("d")).select(
        "ticker", "date", "d.entry", F.coalesce(F.size("d.targets"), F.lit(0)).alias("n_targets")
    )


@query(
    "st_payload",
    ctes("signals") + "SELECT ticker, date, CASE WHEN trading_allowed THEN signal ELSE 'kept ' || signal END AS signal, floor(prob_up * 1e6 + 0.5) / 1e6 AS prob_up FROM signals",
)
def st_payload(t):
    kept = F.to_json(F.struct(F.concat(F.lit("kept "), c("signal")).alias("signal"), "prob_up"))
    stored = t.signals.withColumn("payload", F.when(~c("trading_allowed"), kept))
    doc = F.from_json(store.payload(stored, ["signal", "prob_up"]), "signal string, prob_up double")
    return stored.select("ticker", "date", doc.alias("d")).select("ticker", "date", "d.signal", "d.prob_up")


# --- watchlists ------------------------------------------------------------------


def _flat(df):
    return df.select("name", F.array_join("tickers", ",").alias("tickers"))


@query("wl_create", ctes(**_WL) + "SELECT name, array_to_string(tickers, ',') AS tickers FROM lists WHERE user_id % 2 = 1")
def wl_create(t):
    existing = _lists(t).where(c("user_id") % 2 == 0)
    return _flat(store.new_lists(existing, _raw_lists(t)))


@query(
    "wl_add",
    ctes(**_WL) + "SELECT name, array_to_string(list_sort(list_distinct(list_concat(tickers, ['NEW#1', 'BRAND#1']))), ',') AS tickers FROM lists",
)
def wl_add(t):
    return _flat(store.add_tickers(_lists(t), [" new#1", "brand#1"]))


@query("wl_remove", ctes(**_WL) + "SELECT name, array_to_string(list_filter(tickers, lambda x: x <> 'BRAND#1'), ',') AS tickers FROM lists")
def wl_remove(t):
    return _flat(store.remove_tickers(_lists(t), ["brand#1 "]))


@query("wl_delete", ctes(**_WL) + "SELECT name, array_to_string(tickers, ',') AS tickers FROM lists WHERE user_id % 5 <> 0")
def wl_delete(t):
    return _flat(store.delete_lists(_lists(t), _lists(t).where(c("user_id") % 5 == 0).select("name")))


@query("wl_list", ctes(**_WL) + "SELECT name, array_to_string(tickers, ',') AS tickers FROM lists")
def wl_list(t):
    return _flat(store.all_lists(_lists(t)))


@query("wl_get", ctes(**_WL) + "SELECT name, array_to_string(tickers, ',') AS tickers FROM lists WHERE name = 'wl7'")
def wl_get(t):
    return _flat(store.get_list(_lists(t), "wl7"))


# --- entitlements ---------------------------------------------------------------

_REQ = """SELECT o_orderkey, o_custkey AS user_id, p_brand AS ticker FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"""


@query(
    "ent_filter",
    ctes("users", req=_REQ)
    + """SELECT user_id, ticker, count(*) AS n FROM req JOIN users USING (user_id) WHERE tier = 'pro' OR upper(ticker) IN ('BRAND#1', 'BRAND#2', 'BRAND#3') GROUP BY 1, 2""",
)
def ent_filter(t):
    asked = (
        t.table("orders").select("o_orderkey", c("o_custkey").alias("user_id"))
        .join(t.table("lineitem").select("l_orderkey", "l_partkey"), c("o_orderkey") == c("l_orderkey"))
        .join(t.table("part").select("p_partkey", c("p_brand").alias("ticker")), c("l_partkey") == c("p_partkey"))
    )
    seen = screener.visible(asked.join(t.users, "user_id"), ["Brand#1", "Brand#2", "Brand#3"])
    return seen.groupBy("user_id", "ticker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ent_limits",
    ctes("users")
    + """SELECT user_id, CASE WHEN tier = 'pro' THEN 'pro' ELSE 'free' END AS plan, CAST(CASE WHEN tier = 'pro' THEN 50 ELSE 5 END AS INTEGER) AS max_watchlist_tickers,
    CAST(CASE WHEN tier = 'pro' THEN 4 ELSE 1 END AS INTEGER) AS n_universes, tier = 'pro' AS alerts, CAST(CASE WHEN tier = 'pro' THEN 0 ELSE 24 END AS INTEGER) AS delayed_hours FROM users""",
)
def ent_limits(t):
    out = screener.with_limits(t.users)
    return out.select("user_id", "plan", "max_watchlist_tickers", F.size("universes").alias("n_universes"), "alerts", "delayed_hours")
