"""Signal log with latest-per-key reads, and watchlists.

Writes only append: a batch adds rows to the log and readers take the newest
row per key, so replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

KEY = ["ticker", "trade_date"]


def keyed(signals: DataFrame) -> DataFrame:
    """Rows with a full key, tickers in upper case."""
    return signals.withColumn("ticker", F.upper("ticker")).where((c("ticker") != "") & c("trade_date").isNotNull())


def to_log(signals: DataFrame, batch_id: int) -> DataFrame:
    """Rows ready to append; rows without a full key are skipped."""
    return keyed(signals.withColumn("batch_id", F.lit(batch_id)))


def from_documents(signals: DataFrame) -> DataFrame:
    """Flatten built signals: targets from the list, regime from its status."""
    return signals.withColumns(
        {"tp1": F.get("take_profits", F.lit(0))["price"], "tp2": F.get("take_profits", F.lit(1))["price"], "regime": c("status")}
    )


def newest_first(df: DataFrame, order: str | Column) -> Column:
    """``order``, and among equals a hash of the row, so that the choice never depends on the plan."""
    return F.struct(c(order) if isinstance(order, str) else order, F.xxhash64(*df.columns))


def current(log: DataFrame, order: str | Column = "batch_id") -> DataFrame:
    """Newest row per key, by partial aggregation (no per-key sort)."""
    rest = [x for x in log.columns if x not in KEY]
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), newest_first(log, order)).alias("_r")).select(*KEY, "_r.*")


def compact(log: DataFrame, path: str) -> None:
    """Write the current rows to a new version folder, one partition per date."""
    current(log).repartition("trade_date").write.partitionBy("trade_date").parquet(path)


_SIDES = {"buy": "long", "sell": "short"}


def latest(
    store: DataFrame,
    limit: int = 50,
    only_tradable: bool = False,
    side: str | None = None,
    signals: list[str] | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Rows of the newest date, strongest first."""
    df = store.where(c("trade_date") == store.agg(F.max("trade_date")).scalar())
    if only_tradable:
        df = df.where(F.coalesce(c("trading_allowed"), F.lit(True)))
    if side:
        df = df.where(F.lower("side") == _SIDES.get(side.lower(), side.lower()))
    if signals:
        df = df.where(F.upper("signal").isin([s.upper().replace(" ", "_") for s in signals]))
    if min_confidence is not None:
        df = df.where(F.coalesce("confidence_pct", F.lit(0.0)) >= min_confidence)
    return df.orderBy(c("conviction_pct").desc(), "ticker").limit(limit)


def history(store: DataFrame, ticker: str, limit: int = 30) -> DataFrame:
    return store.where(c("ticker") == ticker.upper()).orderBy(c("trade_date").desc()).limit(limit)


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def clean_json(doc: Column) -> Column:
    """Document text of {entry, targets}: null fields and empty lists vanish."""
    targets = F.array_compact(F.transform(doc["targets"], finite))
    return F.to_json(
        F.struct(finite(doc["entry"]).alias("entry"), F.when(F.size(targets) > 0, targets).alias("targets"))
    )


def payload(rows: DataFrame, columns: list[str]) -> Column:
    """The stored document, else one rebuilt from the columns."""
    return F.coalesce(rows["payload"], F.to_json(F.struct(*[rows[x] for x in columns])))


# --- watchlists -----------------------------------------------------------------


def normalise(tickers: Column) -> Column:
    """Upper case, trimmed, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.transform(tickers, lambda t: F.upper(F.trim(t)))))


def create_lists(raw: DataFrame) -> DataFrame:
    return raw.withColumn("tickers", normalise(c("tickers")))


def new_lists(existing: DataFrame, raw: DataFrame) -> DataFrame:
    """Lists whose name is still free; a taken name is refused."""
    return create_lists(raw).join(existing.select("name"), "name", "left_anti")


def _literal(tickers: list[str]) -> Column:
    return F.array(*[F.lit(t.strip().upper()) for t in tickers])


def add_tickers(lists: DataFrame, tickers: list[str]) -> DataFrame:
    return lists.withColumn("tickers", F.array_sort(F.array_union("tickers", _literal(tickers))))


def remove_tickers(lists: DataFrame, tickers: list[str]) -> DataFrame:
    return lists.withColumn("tickers", F.array_except("tickers", _literal(tickers)))


def delete_lists(lists: DataFrame, names: DataFrame) -> DataFrame:
    return lists.join(names.select("name"), "name", "left_anti")


def all_lists(lists: DataFrame) -> DataFrame:
    return lists.orderBy("name")


def get_list(lists: DataFrame, name: str) -> DataFrame:
    return lists.where(c("name") == name)


def import_lists(docs: DataFrame) -> DataFrame:
    """Lists from documents {name: {tickers, created_at}} (column ``payload``)."""
    shape = "map<string, struct<tickers: array<string>, created_at: string>>"
    rows = docs.select(F.explode(F.from_json("payload", shape)).alias("name", "w"))
    return rows.select("name", "w.tickers", "w.created_at")
