"""Queries over sources, universes and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import store
from barweave.plans.features import _PREP_SQL
from barweave.plans.registry import query
from barweave.plans.sqlparts import cols, ctes
from barweave.session import scratch_path
from barweave.sources import bars as src
from barweave.sources import universe as uni

c = F.col

_OHLCV = "open high low close volume"
_BARS = f"SELECT {cols('ticker date', _OHLCV)} FROM bars"


def _plain(t):
    return t.bars.select("ticker", "date", *src.OHLCV)


@query("src_bars_csv", ctes("bars") + _BARS)
def src_bars_csv(t):
    path = scratch_path(t.spark, "bars-csv")
    src.write_csv(_plain(t), path)
    return src.read_csv(t.spark, path)


@query("src_canonical", ctes("bars") + f"SELECT {cols('ticker date', 'open high low close')}, CASE WHEN TRUE THEN 0::DOUBLE END AS volume FROM (SELECT * REPLACE (CASE WHEN close < open THEN 0 ELSE low END AS low) FROM bars)")
def src_canonical(t):
    text = {n.capitalize(): c(n).cast("string") for n in ("open", "high", "close")}
    vendor = t.bars.select(
        "ticker", c("date").cast("string").alias("Date"), *[v.alias(k) for k, v in text.items()],
        F.when(c("close") >= c("open"), c("low").cast("string")).alias("Low"),
    )
    return src.canonical(vendor)


def _monthly(t, item, doc):
    """One vendor document per ticker and month."""
    rows = t.bars.groupBy("ticker", F.trunc("date", "month").alias("m")).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    return rows.select(F.to_json(doc).alias("payload"))


@query("src_alpaca_json", ctes("bars") + _BARS)
def src_alpaca_json(t):
    stamp = F.concat(c("date").cast("string"), F.lit("T05:00:00Z")).alias("t")
    item = F.struct(stamp, *[c(n).alias(s) for s, n in zip("ohlcv", src.OHLCV)])
    docs = _monthly(t, item, F.struct(F.create_map("ticker", "rows").alias("bars")))
    return src.parse_symbol_map(docs)


@query(
    "src_fmp_json",
    ctes("bars", o="""SELECT ticker, date, CASE WHEN close < open THEN close ELSE open END AS open, CASE WHEN day(date) = 1 THEN close ELSE high END AS high, low, close,
    CASE WHEN day(date) = 2 THEN 0 ELSE volume END AS volume FROM bars WHERE date >= DATE '1997-01-01'""")
    + f"SELECT {cols('ticker date', _OHLCV)} FROM o",
)
def src_fmp_json(t):
    day = F.dayofmonth("date")
    item = F.struct(
        c("date").cast("string").alias("date"),
        F.when(c("close") >= c("open"), c("open")).alias("open"),
        F.when(day != 1, c("high")).otherwise(0.0).alias("high"),
        "low", "close",
        F.when(day != 2, c("volume")).alias("volume"),
    )
    docs = _monthly(t, item, F.struct(c("ticker").alias("symbol"), c("rows").alias("historical")))
    return src.parse_history(docs, "1997-01-01")


def _sources(t):
    """Two vendors: the first knows part of the universe, the second all of it."""
    first = _plain(t).join(t.universe.where(c("sector") != "1").select("ticker"), "ticker", "left_semi")
    return first.withColumns({"source": F.lit("primary"), "priority": F.lit(0)}).unionByName(
        _plain(t).withColumns({"source": F.lit("backup"), "priority": F.lit(1), "close": c("close") + 1})
    )


@query(
    "src_fallback",
    ctes("bars", "universe")
    + """SELECT ticker, date, CASE WHEN sector <> '1' THEN 'primary' ELSE 'backup' END AS source, floor((close + CASE WHEN sector <> '1' THEN 0 ELSE 1 END) * 1e6 + 0.5) / 1e6 AS close
    FROM bars JOIN universe USING (ticker)""",
)
def src_fallback(t):
    return src.with_fallback(_sources(t)).select("ticker", "date", "source", "close")


_SYM = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'c' || c_custkey || 'usd=x' WHEN 1 THEN 'C' || c_custkey || '-usd' WHEN 2 THEN 'c' || c_custkey || '-BTC'
WHEN 3 THEN 'C' || c_custkey || '-eur' ELSE 'EQ' || c_custkey END AS symbol FROM customer"""
_KIND = "CASE WHEN upper(symbol) LIKE '%=X' THEN 'fx' WHEN right(upper(symbol), 4) IN ('-USD', '-BTC', '-EUR') THEN 'crypto' ELSE 'equity' END"


def _symbols(t):
    k = c("c_custkey").cast("string")
    r = c("c_custkey") % 5
    symbol = (
        F.when(r == 0, F.concat(F.lit("c"), k, F.lit("usd=x"))).when(r == 1, F.concat(F.lit("C"), k, F.lit("-usd")))
        .when(r == 2, F.concat(F.lit("c"), k, F.lit("-BTC"))).when(r == 3, F.concat(F.lit("C"), k, F.lit("-eur")))
        .otherwise(F.concat(F.lit("EQ"), k))
    )
    return t.table("customer").select("c_custkey", symbol.alias("symbol"))


@query(
    "src_status",
    f"""WITH s AS ({_SYM}), k AS (SELECT {_KIND} AS kind, c_custkey FROM s)
    SELECT kind, CASE WHEN bool_or(kind = 'equity') THEN 'vendor_a' WHEN bool_or(kind = 'fx') THEN 'vendor_b' ELSE 'vendor_c' END AS primary_source FROM k GROUP BY 1""",
)
def src_status(t):
    s = _symbols(t).select(c("symbol").alias("ticker"), src.symbol_kind(c("symbol")).alias("k"))
    landed = F.array_compact(
        F.array(
            F.when(c("k") == "equity", F.struct(F.lit("vendor_a").alias("source"), F.lit(0).alias("priority"))),
            F.when(c("k") == "fx", F.struct(F.lit("vendor_b").alias("source"), F.lit(1).alias("priority"))),
            F.struct(F.lit("vendor_c").alias("source"), F.lit(2).alias("priority")),
        )
    )
    return src.source_status(s.select("ticker", F.explode(landed).alias("x")).select("ticker", "x.*"))


@query("sym_kind", f"WITH s AS ({_SYM}) SELECT c_custkey, {_KIND} AS kind FROM s")
def sym_kind(t):
    return _symbols(t).select("c_custkey", src.symbol_kind(c("symbol")).alias("kind"))


@query(
    "sym_native",
    f"""WITH s AS ({_SYM}) SELECT c_custkey, CASE WHEN upper(symbol) LIKE '%=X' THEN replace(upper(symbol), '=X', '') WHEN upper(symbol) LIKE '%-USD' THEN replace(upper(symbol), '-USD', 'USD') END AS native FROM s""",
)
def sym_native(t):
    return _symbols(t).select("c_custkey", src.native_symbol(c("symbol")).alias("native"))


@query("period_filter", ctes("bars") + f"SELECT {cols('ticker date', 'close')} FROM bars WHERE date >= (SELECT max(date) FROM bars) - 731")
def period_filter(t):
    return src.within_period(t.bars, "2y").select("ticker", "date", "close")


@query("session_date", "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS session FROM events")
def session_date(t):
    return t.table("events").select("event_id", src.session_date(c("ts")).alias("session"))


@query(
    "dedup_keep_last",
    """SELECT ticker, date, l_orderkey, l_linenumber, price FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_extendedprice AS price,
    row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE k = 1""",
)
def dedup_keep_last(t):
    rows = t.table("lineitem").join(t.table("part"), c("l_partkey") == c("p_partkey")).select(
        c("p_brand").alias("ticker"), c("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber", c("l_extendedprice").alias("price")
    )
    return src.keep_last(rows, ["ticker", "date"], ["l_orderkey", "l_linenumber", "price"])


@query(
    "keep_longer_snapshot",
    ctes("bars", u="SELECT ticker, date, close, 'stored' AS origin FROM bars WHERE date < DATE '1998-10-01' UNION ALL SELECT ticker, date, close, 'fresh' FROM bars WHERE date >= DATE '1998-06-01'",
         k="SELECT ticker, count(*) FILTER (WHERE origin = 'fresh') AS nf, count(*) FILTER (WHERE origin = 'stored') AS ns FROM u GROUP BY 1")
    + f"SELECT {cols('ticker date origin', 'close')} FROM u JOIN k USING (ticker) WHERE origin = CASE WHEN nf >= ns THEN 'fresh' ELSE 'stored' END",
)
def keep_longer_snapshot(t):
    rows = t.bars.select("ticker", "date", "close")
    day = lambda d: F.lit(d).cast("date")
    return src.keep_longer(rows.where(c("date") < day("1998-10-01")), rows.where(c("date") >= day("1998-06-01")))


@query("latest_price", ctes("bars") + "SELECT ticker, arg_max(close, date) AS price, max(date) AS date FROM bars GROUP BY 1")
def latest_price(t):
    return src.latest_price(t.bars)


_COMP = """SELECT lower(replace(s_name, '#', '.')) AS symbol, s_name AS name, CASE WHEN s_nationkey % 4 <> 0 THEN r_name END AS sector,
CASE s_suppkey % 3 WHEN 0 THEN 'Albany, NY' WHEN 1 THEN n_name END AS location FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_UNI = {"comp": _COMP, "un": "SELECT upper(replace(symbol, '.', '-')) AS ticker, name, coalesce(sector, 'Unknown') AS sector, coalesce(location, '') AS exchange FROM comp"}


def _components(t):
    joined = (
        t.table("supplier").join(t.table("nation"), c("s_nationkey") == c("n_nationkey"))
        .join(t.table("region"), c("n_regionkey") == c("r_regionkey"))
    )
    return uni.normalise(
        joined.select(
            F.lower(F.replace("s_name", F.lit("#"), F.lit("."))).alias("symbol"),
            c("s_name").alias("name"),
            F.when(c("s_nationkey") % 4 != 0, c("r_name")).alias("sector"),
            F.when(c("s_suppkey") % 3 == 0, "Albany, NY").when(c("s_suppkey") % 3 == 1, c("n_name")).alias("location"),
        )
    )


@query("universe_norm", ctes(**_UNI) + "SELECT ticker, name, sector, exchange FROM un")
def universe_norm(t):
    return uni.or_fallback(_components(t))


@query("universe_filter", ctes(**_UNI) + "SELECT ticker, exchange FROM un WHERE exchange NOT LIKE '%NY%' ORDER BY ticker LIMIT 40")
def universe_filter(t):
    return uni.exclude_location(_components(t), limit=40).select("ticker", "exchange")


_MEMBERS = (
    " UNION ALL ".join(f"SELECT '{u}' AS universe, unnest([{', '.join(repr(x) for x in ts)}]) AS ticker" for u, ts in uni.LISTS.items())
    + " UNION ALL SELECT 'sp500', ticker FROM un WHERE exchange NOT LIKE '%NY%'"
)
_ASK = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'SP500' WHEN 1 THEN 'ndx100' WHEN 2 THEN 'Fx_major' WHEN 3 THEN 'crypto20' WHEN 4 THEN 'mega' ELSE 'other' END AS name FROM customer"""


def _members(t):
    return uni.memberships(t.spark, uni.exclude_location(_components(t)))


@query(
    "universe_resolve",
    ctes(**_UNI, mem=_MEMBERS, ask=_ASK, n="SELECT universe, count(*) AS n_members FROM mem GROUP BY 1",
         r="SELECT c_custkey, CASE WHEN lower(name) IN (SELECT universe FROM n) THEN lower(name) ELSE 'mega' END AS resolved FROM ask")
    + "SELECT c_custkey, resolved, n_members FROM r JOIN n ON resolved = universe",
)
def universe_resolve(t):
    names = F.array(*[F.lit(x) for x in ("SP500", "ndx100", "Fx_major", "crypto20", "mega", "other")])
    asked = t.table("customer").select("c_custkey", F.element_at(names, (c("c_custkey") % 6 + 1).cast("int")).alias("name"))
    counted = uni.sizes(_members(t)).select(c("universe").alias("resolved"), c("n").alias("n_members"))
    return uni.resolve(asked, _members(t)).join(counted, "resolved").select("c_custkey", "resolved", "n_members")


@query("universe_sizes", ctes(**_UNI, mem=_MEMBERS) + "SELECT universe, count(*) AS n FROM mem GROUP BY 1")
def universe_sizes(t):
    return uni.sizes(_members(t))


@query(
    "lookup_sector_name",
    ctes("bars", "universe") + "SELECT ticker, date, coalesce(sector, 'Unknown') AS sector, coalesce(name, ticker) AS name FROM bars LEFT JOIN (SELECT * FROM universe WHERE sector <> '3') USING (ticker)",
)
def lookup_sector_name(t):
    return uni.lookup(t.bars.select("ticker", "date"), t.universe.where(c("sector") != "3"))


@query(
    "bars_from_ticks",
    """WITH o AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume, count(*) AS n_ticks
    FROM events GROUP BY 1, 2) SELECT ticker, CAST(epoch(start) AS BIGINT) AS start_s, floor(open * 1e6 + 0.5) / 1e6 AS open, floor(high * 1e6 + 0.5) / 1e6 AS high, floor(low * 1e6 + 0.5) / 1e6 AS low,
    floor(close * 1e6 + 0.5) / 1e6 AS close, volume, n_ticks FROM o""",
)
def bars_from_ticks(t):
    return flat_bars(src.from_ticks(ticks(t.table("events"))))


def ticks(events):
    """Events as ticks; naive timestamps are UTC."""
    utc = F.to_timestamp_ltz(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z")))
    return events.select(c("event_type").alias("ticker"), utc.alias("ts"), c("value").alias("price"), F.lit(1.0).alias("size"))


def flat_bars(df):
    return df.select("ticker", F.unix_seconds("start").alias("start_s"), *src.OHLCV, "n_ticks")


# --- watchlist import ------------------------------------------------------------------


@query(
    "import_watchlists",
    """SELECT 'wl' || c_custkey AS name, 'BRAND#' || (c_custkey % 25 + 1) || ',X' || c_custkey AS tickers, '2024-01-01' AS created_at FROM customer""",
)
def import_watchlists(t):
    k = c("c_custkey").cast("string")
    body = F.struct(
        F.array(F.concat(F.lit("BRAND#"), (c("c_custkey") % 25 + 1).cast("string")), F.concat(F.lit("X"), k)).alias("tickers"),
        F.lit("2024-01-01").alias("created_at"),
    )
    docs = t.table("customer").select(F.to_json(F.create_map(F.concat(F.lit("wl"), k), body)).alias("payload"))
    return store.import_lists(docs).select("name", F.array_join("tickers", ",").alias("tickers"), "created_at")


# --- sinks -------------------------------------------------------------------------------


def _prepared(t):
    from barweave.plans.features import _prepared as prepared

    return prepared(t).select("ticker", "date", "close", "target", "ret_20d", "vol_60d")


_SINK = ctes("bars", **_PREP_SQL) + f"SELECT {cols('ticker date target', 'close ret_20d vol_60d')} FROM prep"


@query("sink_processed", _SINK)
def sink_processed(t):
    path = scratch_path(t.spark, "processed")
    src.write_processed(_prepared(t), path)
    return t.spark.read.schema("ticker string, date date, close double, target int, ret_20d double, vol_60d double").parquet(path)


@query("sink_unified", _SINK)
def sink_unified(t):
    path = scratch_path(t.spark, "unified")
    src.write_unified(_prepared(t), path, "2000-12-31")
    return t.spark.read.parquet(f"{path}/latest")


@query("sink_predictions", ctes("signals") + f"SELECT {cols('ticker date signal', 'prob_up price')} FROM signals")
def sink_predictions(t):
    path = scratch_path(t.spark, "predictions")
    src.write_predictions(t.signals.select("ticker", "date", "signal", "prob_up", "price"), path)
    return t.spark.read.schema("ticker string, date date, signal string, prob_up double, price double").csv(path, header=True)
