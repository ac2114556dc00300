"""Queries over indicator columns, targets and walk-forward splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave import panel
from barweave.functions import exprs
from barweave.operators import features as f
from barweave.operators import splits, targets
from barweave.plans.registry import QUERIES, query
from barweave.plans.sqlparts import W, cols, ctes, decayed, full

c = F.col


def indicator(name: str, step, doubles: str, body: str, needs: str = "bars", plain: str = "", **extra: str) -> None:
    """Register one indicator step; ``body`` is the SQL select list."""
    source = needs.split()[-1]
    sql = (
        ctes(*needs.split(), **extra, out=f"SELECT *, {body} FROM {list(extra)[-1] if extra else source}")
        + f"SELECT {cols('ticker date ' + plain, doubles)} FROM out"
    )

    @query(name, sql)
    def build(t):
        return f.compute(t.bars, [step]).select("ticker", "date", *plain.split(), *doubles.split())


def _pct(column: str, n: int, alias: str) -> str:
    return f"{column} / lag({column}, {n}) OVER ({W}) - 1 AS {alias}"


indicator(
    "f_returns", f.returns, "ret_1d ret_3d ret_5d ret_10d ret_20d",
    ", ".join(_pct("close", n, f"ret_{n}d") for n in (1, 3, 5, 10, 20)),
)
indicator(
    "f_volatility", f.volatility, "vol_5d vol_10d vol_20d vol_60d",
    ", ".join(f"{full(n, 'stddev_samp(ret_1d)', 'ret_1d')} AS vol_{n}d" for n in (5, 10, 20, 60)), "rets",
)
_SMA = ", ".join(f"{full(n, 'avg(close)', 'close')} AS sma_{n}" for n in (10, 20, 50, 200))
indicator("f_sma", f.sma, "sma_10 sma_20 sma_50 sma_200", _SMA)
_EMA = ", ".join(f"{decayed('close', 2 / (n + 1), '(seq - 1)')} AS ema_{n}" for n in (12, 26))
indicator("f_ema", f.emas, "ema_12 ema_26", _EMA)
indicator(
    "f_dist_sma", f.dist_sma, "dist_sma_10 dist_sma_20 dist_sma_50",
    ", ".join(f"(close - sma_{n}) / sma_{n} AS dist_sma_{n}" for n in (10, 20, 50)),
    sma=f"SELECT *, {_SMA} FROM bars",
)
_MACD = {
    "ema": f"SELECT *, {_EMA} FROM bars",
    "line": "SELECT *, CASE WHEN seq >= 26 THEN ema_12 - ema_26 END AS macd FROM ema",
    "sig": f"SELECT *, CASE WHEN seq >= 34 THEN {decayed('macd', 0.2, '(seq - 26)')} END AS macd_signal FROM line",
}
indicator(
    "f_macd", f.macd, "macd macd_signal macd_diff macd_norm macd_diff_norm",
    "macd - macd_signal AS macd_diff, macd / close AS macd_norm, (macd - macd_signal) / close AS macd_diff_norm",
    **_MACD,
)
indicator(
    "f_bollinger", f.bollinger, "bb_mid bb_high bb_low bb_width bb_pct",
    "mid AS bb_mid, mid + 2 * sd AS bb_high, mid - 2 * sd AS bb_low, 4 * sd / mid AS bb_width, "
    "(close - mid + 2 * sd) / nullif(4 * sd, 0) AS bb_pct",
    mid=f"SELECT *, {full(20, 'avg(close)', 'close')} AS mid, {full(20, 'stddev_pop(close)', 'close')} AS sd FROM bars",
)
indicator("f_atr", f.atr, "atr atr_pct", "atr / close AS atr_pct", "atrs")
_ADX = {
    "moves": f"SELECT *, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS down FROM tr",
    "dm": "SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, "
    "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM moves",
    "seeds": "SELECT *, " + ", ".join(f"{full(14, f'avg({x})', x)} AS seed_{x}" for x in ("tr_null", "pdm", "mdm")) + " FROM dm",
    "smooth": "SELECT *, " + ", ".join(
        f"{decayed(x, 1 / 14, '(seq - 15)', f'seed_{x}')} AS s_{x}" for x in ("tr_null", "pdm", "mdm")) + " FROM seeds",
    "dx": "SELECT *, CASE WHEN s_tr_null IS NOT NULL THEN "
    "coalesce(abs(s_pdm - s_mdm) / nullif(s_pdm + s_mdm, 0), 0) * 100 END AS dx FROM smooth",
    "dx14": f"SELECT *, {full(14, 'avg(dx)', 'dx')} AS seed_dx FROM dx",
}
indicator("f_adx", f.adx, "adx", f"{decayed('dx', 1 / 14, '(seq - 28)', 'seed_dx')} AS adx", "tr", **_ADX)
_HL14 = f"SELECT *, {full(14, 'max(high)', 'high')} AS hh, {full(14, 'min(low)', 'low')} AS ll FROM bars"
indicator(
    "f_stochastic", f.stochastic, "stoch_k stoch_d", f"{full(3, 'avg(stoch_k)', 'stoch_k')} AS stoch_d",
    hl=_HL14, k="SELECT *, 100 * (close - ll) / nullif(hh - ll, 0) AS stoch_k FROM hl",
)
indicator(
    "f_williams_r", f.williams_r, "williams_r", "-100 * (hh - close) / nullif(hh - ll, 0) AS williams_r", hl=_HL14
)
indicator(
    "f_cci", f.cci, "cci", "(tp - m) / nullif(0.015 * mad, 0) AS cci",
    tps="SELECT *, (high + low + close) / 3 AS tp FROM bars",
    mean=f"SELECT *, {full(20, 'avg(tp)', 'tp')} AS m, "
    f"{full(20, 'list(tp)', 'tp')} AS l FROM tps",
    mads="SELECT *, list_avg(list_transform(l, lambda x: abs(x - m))) AS mad FROM mean",
)
indicator(
    "f_rsi", f.rsi, "rsi",
    "CASE WHEN seq >= 14 THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END END AS rsi",
    "rets",
    moves="SELECT *, greatest(coalesce(close - prev_close, 0), 0) AS g, greatest(coalesce(prev_close - close, 0), 0) AS l FROM rets",
    avgs=f"SELECT *, {decayed('g', 1 / 14, '(seq - 1)')} AS up, {decayed('l', 1 / 14, '(seq - 1)')} AS dn FROM moves",
)
indicator(
    "f_vwap", f.vwap, "vwap dist_vwap", "(close - vwap) / vwap AS dist_vwap",
    v=f"SELECT *, {full(14, 'sum((high + low + close) / 3 * volume)', 'volume')} / {full(14, 'sum(volume)', 'volume')} AS vwap FROM bars",
)
indicator(
    "f_volume", f.volume, "volume_sma_20 volume_ratio volume_roc",
    f"volume / volume_sma_20 AS volume_ratio, {_pct('volume', 5, 'volume_roc')}",
    v=f"SELECT *, {full(20, 'avg(volume)', 'volume')} AS volume_sma_20 FROM bars",
)
indicator(
    "f_momentum", f.momentum, "momentum_5 momentum_10 momentum_20",
    ", ".join(_pct("close", n, f"momentum_{n}") for n in (5, 10, 20)),
)
indicator(
    "f_lag_returns", f.lag_returns, "lag_ret_1 lag_ret_2 lag_ret_3 lag_ret_5 lag_ret_10",
    ", ".join(f"lag(ret_1d, {n}) OVER ({W}) AS lag_ret_{n}" for n in (1, 2, 3, 5, 10)), "rets",
)
indicator(
    "f_range20", f.range20, "high_20d low_20d range_20d", "(high_20d - low_20d) / close AS range_20d",
    r=f"SELECT *, {full(20, 'max(high)', 'high')} AS high_20d, {full(20, 'min(low)', 'low')} AS low_20d FROM bars",
)
indicator("f_median20", f.median20, "median_20d", f"{full(20, 'median(close)', 'close')} AS median_20d")
indicator(
    "f_candle", f.candle, "body upper_shadow lower_shadow total_range body_pct",
    "abs(close - open) AS body, high - greatest(open, close) AS upper_shadow, least(open, close) - low AS lower_shadow, "
    "high - low AS total_range, abs(close - open) / nullif(high - low, 0) AS body_pct",
)
indicator(
    "f_calendar", f.calendar, "", 
    "CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, "
    "CAST(quarter(date) AS INTEGER) AS quarter, CAST(day(date) AS INTEGER) AS day_of_month, "
    "CAST(day(date) > 25 AS INTEGER) AS is_month_end, CAST(day(date) <= 5 AS INTEGER) AS is_month_start",
    plain="day_of_week month quarter day_of_month is_month_end is_month_start",
)


@query(
    "f_obv",
    ctes("rets", o=f"SELECT *, sum(CASE WHEN close < prev_close THEN -volume ELSE volume END) OVER ({W}) AS obv, "
         f"{full(20, 'sum(volume)', 'volume')} AS v20 FROM rets", out="SELECT *, obv / v20 AS obv_ratio_20d FROM o")
    + f"SELECT {cols('ticker date', 'obv obv_ratio_20d')} FROM out",
)
def f_obv(t):
    return f.compute(t.bars, [f.obv_ratio]).select("ticker", "date", "obv", "obv_ratio_20d")


_MARKET_CTX = {
    "mr": "SELECT *, close / lag(close) OVER (ORDER BY date) - 1 AS market_ret_1d, "
    "close / lag(close, 5) OVER (ORDER BY date) - 1 AS market_ret_5d, "
    f"{full(20, 'avg(close)', 'close', 'ORDER BY date')} AS s20 FROM market",
    "mctx": "SELECT date, market_ret_1d, market_ret_5d, (close - s20) / s20 AS market_dist_sma_20, "
    f"{full(20, 'stddev_samp(market_ret_1d)', 'market_ret_1d', 'ORDER BY date')} AS market_vol_20d FROM mr",
}
_VIX_CTX = {
    "vs": f"SELECT *, {full(60, 'avg(close)', 'close', 'ORDER BY date')} AS m, "
    f"{full(60, 'stddev_samp(close)', 'close', 'ORDER BY date')} AS s FROM vix",
    "vctx": "SELECT date, close AS vix_level, (close - m) / nullif(s, 0) AS vix_zscore, "
    "close / lag(close, 5) OVER (ORDER BY date) - 1 AS vix_change_5d FROM vs",
}


@query(
    "f_ctx_market",
    ctes("bars", "market", **_MARKET_CTX)
    + f"SELECT {cols('ticker date', 'market_ret_1d market_ret_5d market_dist_sma_20 market_vol_20d')} FROM bars LEFT JOIN mctx USING (date)",
)
def f_ctx_market(t):
    return f.join_context(t.bars, market=t.market).select(
        "ticker", "date", "market_ret_1d", "market_ret_5d", "market_dist_sma_20", "market_vol_20d"
    )


@query(
    "f_ctx_vix",
    ctes("bars", "vix", **_VIX_CTX)
    + f"SELECT {cols('ticker date', 'vix_level vix_zscore vix_change_5d')} FROM bars LEFT JOIN vctx USING (date)",
)
def f_ctx_vix(t):
    return f.join_context(t.bars, vix=t.vix).select("ticker", "date", "vix_level", "vix_zscore", "vix_change_5d")


_W20 = f"({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    "f_ctx_corr",
    ctes("rets", "market", **_MARKET_CTX,
         pairs="SELECT ticker, date, ret_1d, market_ret_1d, ret_1d + market_ret_1d AS pair FROM rets LEFT JOIN mctx USING (date)",
         out=f"SELECT ticker, date, CASE WHEN count(pair) OVER {_W20} = 20 THEN corr(ret_1d, market_ret_1d) OVER {_W20} END AS market_corr_20d FROM pairs")
    + f"SELECT {cols('ticker date', 'market_corr_20d')} FROM out",
)
def f_ctx_corr(t):
    joined = f.join_context(t.bars, market=t.market)
    return f.compute(joined, [f.market_corr]).select("ticker", "date", "market_corr_20d")


def joined_sql(names: list[str]) -> str:
    """Bars joined with the SQL of several indicator queries."""
    base = ctes("bars") + "SELECT ticker, date, open, high, low, close, volume, prob_up, seq FROM bars"
    return f"SELECT * FROM ({base})" + "".join(f" JOIN ({QUERIES[n].sql}) USING (ticker, date)" for n in names)


_ALL = [n for n in QUERIES if n.startswith("f_")]
# rows that hold all model features
_COMPLETE = f"SELECT * FROM ({joined_sql(_ALL)}) WHERE {' AND '.join(f'{x} IS NOT NULL' for x in f.MODEL_FEATURES)}"


@query("f_all", joined_sql(_ALL))
def f_all(t):
    return t.features.drop("seg")


@query(
    "f_chart_overlays",
    ctes("bars", n="SELECT ticker, count(*) AS n FROM bars GROUP BY 1",
         tail="SELECT b.*, least(n, 260) AS m, seq - greatest(n - 259, 1) AS i FROM bars b JOIN n USING (ticker) WHERE seq > n - 260",
         out=f"SELECT *, {', '.join(decayed('close', 2 / (n + 1), 'i') + f' AS e{n}' for n in (20, 50, 200))}, "
             f"{full(20, 'avg(close)', 'close')} AS mid, {full(20, 'stddev_samp(close)', 'close')} AS sd FROM tail",
         fin="SELECT ticker, date, open, high, low, close, volume, CASE WHEN m > 210 THEN e20 END AS ema20, CASE WHEN m > 210 THEN e50 END AS ema50, "
             "CASE WHEN m > 210 THEN e200 END AS ema200, CASE WHEN m > 210 THEN mid + 2 * sd END AS bb_upper, "
             "CASE WHEN m > 210 THEN mid - 2 * sd END AS bb_lower FROM out")
    + f"SELECT {cols('ticker date', 'open high low close volume ema20 ema50 ema200 bb_upper bb_lower rsi macd macd_signal')} FROM fin"
    + "".join(f" LEFT JOIN (SELECT ticker, date, {names} FROM ({QUERIES[q].sql})) USING (ticker, date)" for q, names in (("f_rsi", "rsi"), ("f_macd", "macd, macd_signal"))),
)
def f_chart_overlays(t):
    return f.chart_overlays(t.bars, t.features)


# --- scalar helpers ---------------------------------------------------------


@query(
    "s_safe_divide",
    "SELECT l_orderkey, l_linenumber, floor((CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END) * 1e6 + 0.5) / 1e6 AS ratio FROM lineitem",
)
def s_safe_divide(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", exprs.safe_divide(c("l_discount"), c("l_tax")).alias("ratio"))


@query(
    "s_change_pct",
    "SELECT l_orderkey, l_linenumber, floor((l_discount - l_tax) / nullif(l_tax, 0) * 100 * 1e6 + 0.5) / 1e6 AS change_pct FROM lineitem",
)
def s_change_pct(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", exprs.change_pct(c("l_discount"), c("l_tax")).alias("change_pct"))


@query(
    "s_format",
    "SELECT o_orderkey, format('${:,.2f}', o_totalprice) AS price_text, strftime(o_orderdate, '%Y%m%d') AS date_text FROM orders",
)
def s_format(t):
    return t.table("orders").select(
        "o_orderkey",
        exprs.currency(c("o_totalprice")).alias("price_text"),
        exprs.compact_date(c("o_orderdate")).alias("date_text"),
    )


@query("s_format_pct", "SELECT l_orderkey, l_linenumber, printf('%.2f%%', l_discount * 100) AS discount_text FROM lineitem")
def s_format_pct(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", exprs.percentage(c("l_discount")).alias("discount_text"))


# --- targets ----------------------------------------------------------------


@query("t_direction", ctes("bars") + f"SELECT ticker, date, coalesce(CAST(lead(close) OVER ({W}) > close AS INTEGER), 0) AS target FROM bars")
def t_direction(t):
    return panel.windowed(t.bars, [targets.add_direction()], ahead=1).select("ticker", "date", "target")


@query(
    "t_return_1",
    ctes("bars", out=f"SELECT *, lead(close) OVER ({W}) / close - 1 AS target_return FROM bars")
    + f"SELECT {cols('ticker date', 'target_return')} FROM out",
)
def t_return_1(t):
    return panel.windowed(t.bars, [targets.add_next_return], ahead=1).select("ticker", "date", "target_return")


@query(
    "t_return_5",
    ctes("bars", out=f"SELECT *, lead(close, 5) OVER ({W}) / lead(close, 4) OVER ({W}) - 1 AS target_return_5d, "
         f"lead(close, 5) OVER ({W}) / close - 1 AS target_return_5bar FROM bars")
    + f"SELECT {cols('ticker date', 'target_return_5d target_return_5bar')} FROM out",
)
def t_return_5(t):
    return panel.windowed(t.bars, [targets.add_return_at_5], ahead=5).select(
        "ticker", "date", "target_return_5d", "target_return_5bar"
    )


# Rows that hold all model features, in both languages.
_PREP = f.MODEL_FEATURES
_WHOLE = ["day_of_week", "month", "quarter", "day_of_month", "is_month_end", "is_month_start"]


def _prepared(t):
    return targets.drop_incomplete(panel.windowed(t.features, [targets.add_direction()], ahead=1), _PREP)


_PREP_SQL = {
    "aimed": f"SELECT ticker, date, coalesce(CAST(lead(close) OVER ({W}) > close AS INTEGER), 0) AS target FROM bars",
    "prep": f"SELECT * FROM ({_COMPLETE}) JOIN aimed USING (ticker, date)",
}


@query("prep_mask", ctes("bars", **_PREP_SQL) + f"SELECT {cols(' '.join(['ticker date target', *_WHOLE]), ' '.join(x for x in _PREP if x not in _WHOLE))} FROM prep")
def prep_mask(t):
    return _prepared(t).select("ticker", "date", "target", *_PREP)


_NAMED = [*((p, p) for p in _PREP), ("always_one", "1"), ("never", "NULL::DOUBLE")]


@query(
    "prep_drop_constant",
    ctes("bars", **_PREP_SQL)
    + f"SELECT unnest([{', '.join(repr(x) for x, _ in _NAMED)}]) AS feature, unnest([{', '.join(f'coalesce(min({e}) < max({e}), false)' for _, e in _NAMED)}]) AS keep FROM prep",
)
def prep_drop_constant(t):
    df = _prepared(t).withColumns({"always_one": F.lit(1.0), "never": F.lit(None).cast("double")})
    return targets.feature_report(df, [*_PREP, "always_one", "never"])


@query(
    "prep_ticker_counts",
    ctes("bars", **_PREP_SQL)
    + "SELECT ticker, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_up, CAST(sum(1 - target) AS BIGINT) AS n_down FROM prep GROUP BY 1",
)
def prep_ticker_counts(t):
    return targets.ticker_counts(_prepared(t))


@query(
    "prep_class_weight",
    ctes("bars", **_PREP_SQL, k="SELECT target, count(*) AS n FROM prep GROUP BY 1",
         out="SELECT target, n, (SELECT sum(n) FROM k) / (2.0::DOUBLE * n) AS weight, "
             "(SELECT max(n) FROM k WHERE target = 0) / (SELECT max(n) FROM k WHERE target = 1)::DOUBLE AS positive_weight FROM k")
    + f"SELECT {cols('target n', 'weight positive_weight')} FROM out",
)
def prep_class_weight(t):
    return targets.class_weights(_prepared(t))


_SUBSET = ["f_returns", "f_volatility", "f_dist_sma", "f_rsi", "f_volume", "f_calendar"]


@query("prep_feature_subset", f"SELECT ticker, date, {', '.join(f.BASIC_FEATURES)} FROM ({joined_sql(_SUBSET)})")
def prep_feature_subset(t):
    names = targets.subset(t.features, f.BASIC_FEATURES)
    return t.features.select("ticker", "date", *names)


@query(
    "split_temporal",
    ctes("bars", r="SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) AS seq, count(*) OVER () AS n FROM bars")
    + "SELECT ticker, date, seq, CASE WHEN seq <= floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS role FROM r",
)
def split_temporal(t):
    return targets.split_temporal(t.bars).select("ticker", "date", "seq", "role")


# --- walk-forward splits ------------------------------------------------------

_BOUNDS = """SELECT *, n // 10 AS min_train, (n - n // 10 - 65) // 5 AS ts FROM {src}"""
_FOLDS = """SELECT *, n - (5 - fold) * ts AS test_start, n - (5 - fold) * ts + ts AS test_end, n - (5 - fold) * ts - 65 AS train_end
FROM b, (SELECT unnest(range(5)) AS fold) WHERE ts >= 20"""


@query(
    "cv_serial",
    ctes("bars", n="SELECT ticker, count(*) AS n FROM bars GROUP BY 1", b=_BOUNDS.format(src="n"), folds=_FOLDS)
    + """SELECT f.ticker, CAST(fold AS INTEGER) AS fold, CASE WHEN seq <= train_end THEN 'train' ELSE 'test' END AS role, date
    FROM folds f JOIN bars USING (ticker) WHERE seq <= train_end OR (seq > test_start AND seq <= test_end)""",
)
def cv_serial(t):
    return splits.serial_folds(t.bars).select("ticker", "fold", "role", "date")


_PANEL = dict(
    d="SELECT date, row_number() OVER (ORDER BY date) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)",
    b=_BOUNDS.format(src="(SELECT max(n) AS n FROM d)"),
    folds=_FOLDS,
    panel="""SELECT ticker, date, fold, CASE WHEN rank <= train_end THEN 'train' ELSE 'test' END AS role
    FROM folds JOIN d ON rank <= train_end OR (rank > test_start AND rank <= test_end) JOIN bars USING (date)""",
)


@query("cv_panel", ctes("bars", **_PANEL) + "SELECT ticker, date, CAST(fold AS INTEGER) AS fold, role FROM panel")
def cv_panel(t):
    return splits.panel_folds(t.bars).select("ticker", "date", "fold", "role")


@query(
    "cv_coverage",
    ctes("bars", **_PANEL)
    + """SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date
    FROM panel GROUP BY 1, 2""",
)
def cv_coverage(t):
    return splits.coverage(splits.panel_folds(t.bars))


@query(
    "cv_errors",
    ctes("bars", n="SELECT ticker, year(date) AS year, count(*) AS n FROM bars GROUP BY 1, 2")
    + """SELECT ticker, CAST(year AS INTEGER) AS year, n, CASE WHEN (n - n // 10 - 65) // 5 < 20 THEN 'test window too small' ELSE 'ok' END AS verdict FROM n""",
)
def cv_errors(t):
    groups = t.bars.groupBy("ticker", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("verdict", splits.verdict(c("n"), splits.Geometry()))
