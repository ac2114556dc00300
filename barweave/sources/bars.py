"""Reading landed bar data into the canonical panel shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave import panel

c = F.col

OHLCV = ["open", "high", "low", "close", "volume"]

# Calendar days behind each period code.
PERIOD_DAYS = {
    "1d": 2, "5d": 7, "1mo": 31, "3mo": 92, "6mo": 183,
    "1y": 366, "2y": 731, "3y": 1096, "5y": 1827, "10y": 3653,
}
DEFAULT_PERIOD_DAYS = 366


def canonical(raw: DataFrame) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) from vendor rows of any case.

    Missing columns and missing values become 0.
    """
    by_name = {x.lower(): x for x in raw.columns}
    value = lambda n: F.coalesce(c(by_name[n]).cast("double"), F.lit(0.0)) if n in by_name else F.lit(0.0)
    return raw.select(
        c(by_name["ticker"]).alias("ticker"), F.to_date(c(by_name["date"])).alias("date"), *[value(n).alias(n) for n in OHLCV]
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-ticker bar files; the first column is a zoned timestamp, read as a UTC date.

    The ticker comes from a ``ticker=`` folder or from a ``<ticker>_raw.csv`` file name.
    """
    schema = "ts string, open double, high double, low double, close double, volume double"
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").option("header", "true").csv(path)
    raw = raw.withColumn("_path", F.try_url_decode(F.col("_metadata.file_path")))
    # folder names of partitioned writes are escaped once more
    folder = F.try_url_decode(F.regexp_extract("_path", r"/ticker=([^/]+)/[^/]+$", 1))
    file = F.regexp_extract("_path", r"/([^/]+)_raw\.csv$", 1)
    ticker = F.when(folder != "", folder).otherwise(file)
    day = F.coalesce(F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ssXXX")), F.try_to_timestamp("ts")).cast("date")
    return raw.select(ticker.alias("ticker"), day.alias("date"), *OHLCV)


def write_csv(bars: DataFrame, path: str) -> None:
    """One folder per ticker with a zoned timestamp column."""
    stamp = F.concat(c("date").cast("string"), F.lit(" 05:00:00+00:00")).alias("ts")
    balanced(bars.select(stamp, *OHLCV, "ticker"), "ticker").write.partitionBy("ticker").csv(path, header=True)


def prepare(bars: DataFrame) -> DataFrame:
    """Number the rows of each ticker; the entry point of every operator."""
    return panel.sequence(bars)


_BAR_MAP = "struct<bars: map<string, array<struct<t: string, o: double, h: double, l: double, c: double, v: double>>>>"


def parse_symbol_map(docs: DataFrame, column: str = "payload") -> DataFrame:
    """Flatten documents {bars: {symbol: [{t, o, h, l, c, v}]}}."""
    parsed = docs.select(F.explode(F.from_json(column, _BAR_MAP)["bars"]).alias("ticker", "rows"))
    rows = parsed.select("ticker", F.explode("rows").alias("b"))
    named = [c(f"b.{s}").alias(n) for s, n in zip("ohlcv", OHLCV)]
    return canonical(rows.select("ticker", F.substring("b.t", 1, 10).alias("date"), *named))


_HISTORY = "struct<symbol: string, historical: array<struct<date: string, open: double, high: double, low: double, close: double, volume: double>>>"


def parse_history(docs: DataFrame, start: str, column: str = "payload") -> DataFrame:
    """Flatten documents {symbol, historical: [...]} from ``start`` on.

    An open, high or low that is missing or zero falls back to the close.
    """
    doc = docs.select(F.from_json(column, _HISTORY).alias("d"))
    rows = doc.select(c("d.symbol").alias("ticker"), F.explode("d.historical").alias("b")).select("ticker", "b.*")
    kept = rows.where(c("date") >= start)
    filled = {n: F.coalesce(F.nullif(n, F.lit(0.0)), c("close")) for n in ("open", "high", "low")}
    return canonical(kept.withColumns(filled))


def with_fallback(sources: DataFrame) -> DataFrame:
    """Per symbol, the rows of the best source that has any.

    ``sources`` is a union with ``source`` and ``priority`` (lower is better).
    """
    best = sources.groupBy("ticker").agg(F.min("priority").alias("priority"))
    return sources.join(best, ["ticker", "priority"])


def source_status(sources: DataFrame) -> DataFrame:
    """The primary source of each asset class."""
    kinds = sources.withColumn("kind", symbol_kind(c("ticker")))
    return kinds.groupBy("kind").agg(F.min_by("source", "priority").alias("primary_source"))


def symbol_kind(symbol: Column) -> Column:
    """fx (``=X``), crypto (``-USD``, ``-BTC``, ``-EUR``) or equity."""
    s = F.upper(symbol)
    return F.when(s.endswith("=X"), "fx").when(s.rlike("-(USD|BTC|EUR)$"), "crypto").otherwise("equity")


def native_symbol(symbol: Column) -> Column:
    """The pair without its suffix; null for equities and other crosses."""
    s = F.upper(symbol)
    return F.when(s.endswith("=X"), F.replace(s, F.lit("=X"), F.lit(""))).when(
        s.endswith("-USD"), F.replace(s, F.lit("-USD"), F.lit("USD"))
    )


def period_days(period: str) -> int:
    """Days behind a period code; an unknown ``Ny`` counts as a year, other ``Nx`` as N days."""
    code = str(period).lower()
    if code in PERIOD_DAYS:
        return PERIOD_DAYS[code]
    number = code[:-1]
    return int(number) if number.isdigit() and not code.endswith("y") else DEFAULT_PERIOD_DAYS


def within_period(bars: DataFrame, period: str) -> DataFrame:
    """Bars of the last ``period``, counted back from the newest bar."""
    newest = bars.agg(F.max("date")).scalar()
    return bars.where(c("date") >= F.date_sub(newest, period_days(period)))


def session_date(ts: Column, zone: str = "America/New_York", source_zone: str | None = "UTC") -> Column:
    """Trading date of a timestamp; ``source_zone=None`` leaves naive times as they are."""
    return F.to_date(F.convert_timezone(F.lit(source_zone), F.lit(zone), ts) if source_zone else ts)


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key, by partial aggregation."""
    rest = [x for x in rows.columns if x not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def keep_longer(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per ticker the fresh history if it has at least as many rows, else the stored one."""
    size = lambda df, name: df.groupBy("ticker").agg(F.count(F.lit(1)).alias(name))
    sizes = size(stored, "_old").join(size(fresh, "_new"), "ticker", "full")
    use_new = F.coalesce("_new", F.lit(0)) >= F.coalesce("_old", F.lit(0))
    chosen = sizes.select("ticker", F.when(use_new, "fresh").otherwise("stored").alias("origin"))
    both = stored.withColumn("origin", F.lit("stored")).unionByName(fresh.withColumn("origin", F.lit("fresh")))
    return both.join(chosen, ["ticker", "origin"])


def latest_price(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("date"))


def from_ticks(ticks: DataFrame, window: str = "1 hour") -> DataFrame:
    """Roll (ticker, ts, price, size) up to bars; works on batches and streams."""
    out = ticks.groupBy("ticker", F.window("ts", window).alias("w")).agg(
        F.min_by("price", "ts").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"),
        F.sum("size").alias("volume"),
        F.count(F.lit(1)).alias("n_ticks"),
    )
    return out.select("ticker", c("w.start").alias("start"), *OHLCV, "n_ticks")


# --- sinks ------------------------------------------------------------------------


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, so that it gets few files; adaptive execution splits hot keys and joins small partitions."""
    return df.hint("rebalance", *[c(k) for k in keys])


def write_processed(df: DataFrame, path: str, rows_a_file: int = 5_000_000) -> None:
    """Processed rows, one folder per ticker: a small ticker has one file, a large one as many as it needs."""
    balanced(df, "ticker").write.option("maxRecordsPerFile", rows_a_file).partitionBy("ticker").parquet(path)


def write_unified(df: DataFrame, path: str, day: str) -> None:
    """A dated copy and the latest copy of the whole panel."""
    df.write.parquet(f"{path}/dated={day}")
    df.write.mode("overwrite").parquet(f"{path}/latest")


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
