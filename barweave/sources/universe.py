"""Named groups of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

# Symbol lists.
LIQUID = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "TSLA", "AVGO", "BRK.B", "LLY", "JPM", "V", "UNH", "XOM", "MA", "COST", "HD", "PG", "WMT", "JNJ",
    "ORCL", "MRK", "ADBE", "CRM", "NFLX", "AMD", "KO", "PEP", "BAC", "TMO", "LIN", "CSCO", "ACN", "MCD", "ABT", "WFC", "DIS", "INTC", "QCOM", "TXN",
    "CAT", "GE", "VZ", "IBM", "NOW", "AMGN", "DHR", "NEE", "PM", "UNP", "SPGI", "LOW", "RTX", "HON", "UPS", "BA", "SBUX", "GS", "MS", "BLK",
]
NDX100 = [
    "AAPL", "ADBE", "ADI", "ADP", "AMAT", "AMD", "AMGN", "AMZN", "ARM", "ASML", "AVGO", "BKNG", "CDNS", "CEG", "CHTR", "CMCSA", "COST", "CSCO", "CSX", "CTAS",
    "CTSH", "DASH", "DDOG", "EXC", "FTNT", "GILD", "GOOG", "GOOGL", "HON", "INTC", "INTU", "ISRG", "KDP", "LULU", "MDB", "MELI", "META", "MNST", "MRNA", "MSFT", "MU", "NFLX", "NVDA", "ODFL",
    "PANW", "PDD", "PEP", "PYPL", "QCOM", "REGN", "ROST", "SBUX", "SMCI", "SNPS", "TEAM", "TSLA", "TXN", "VRTX", "XEL", "ZS",
]
FX_MAJOR = [
    "EURUSD=X", "GBPUSD=X", "USDJPY=X", "USDCHF=X", "AUDUSD=X", "USDCAD=X", "NZDUSD=X", "EURGBP=X", "EURJPY=X", "GBPJPY=X",
]
CRYPTO20 = [
    "BTC-USD", "ETH-USD", "SOL-USD", "ADA-USD", "XRP-USD", "DOGE-USD", "AVAX-USD", "DOT-USD", "MATIC-USD", "LINK-USD",
    "LTC-USD", "BCH-USD", "UNI-USD", "ATOM-USD", "XLM-USD", "NEAR-USD", "APT-USD", "ARB-USD", "OP-USD", "FIL-USD",
]
FALLBACK = "mega"
UNKNOWN = "Unknown"

LISTS = {"mega": LIQUID[:20], "ndx100": NDX100, "fx_major": FX_MAJOR, "crypto20": CRYPTO20}


def normalise(components: DataFrame) -> DataFrame:
    """(ticker, name, sector, exchange) from a component table.

    Class shares use a dash; an unknown sector or location gets a placeholder.
    """
    return components.select(
        F.upper(F.replace("symbol", F.lit("."), F.lit("-"))).alias("ticker"),
        "name",
        F.coalesce("sector", F.lit(UNKNOWN)).alias("sector"),
        F.coalesce("location", F.lit("")).alias("exchange"),
    )


def or_fallback(universe: DataFrame) -> DataFrame:
    """The embedded liquid list when ``universe`` is empty."""
    spark = universe.sparkSession
    embedded = spark.createDataFrame([(t, t, UNKNOWN, "?") for t in LIQUID], "ticker string, name string, sector string, exchange string")
    return universe.unionByName(embedded.where(universe.limit(1).agg(F.count(F.lit(1))).scalar() == 0))


def exclude_location(universe: DataFrame, text: str = "NY", limit: int | None = None) -> DataFrame:
    """Drop rows whose exchange text contains ``text``."""
    kept = universe.where(~F.coalesce(c("exchange").contains(text), F.lit(False)))
    return kept.orderBy("ticker").limit(limit) if limit else kept


def memberships(spark: SparkSession, sp500: DataFrame) -> DataFrame:
    """(universe, ticker) of every registered universe; ``sp500`` comes from the component table."""
    fixed = spark.createDataFrame([(u, t) for u, ts in LISTS.items() for t in ts], "universe string, ticker string")
    return fixed.unionByName(sp500.select(F.lit("sp500").alias("universe"), "ticker"))


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("universe").agg(F.count(F.lit(1)).alias("n"))


def resolve(requests: DataFrame, members: DataFrame, strict: bool = False) -> DataFrame:
    """Attach ``resolved``: the asked universe if registered, else the fallback.

    With ``strict`` an unknown name gives null, for the caller to reject.
    """
    names = members.select(c("universe").alias("_u")).distinct()
    joined = requests.join(names, F.lower("name") == c("_u"), "left")
    fallback = F.lit(None).cast("string") if strict else F.lit(FALLBACK)
    return joined.withColumn("resolved", F.coalesce("_u", fallback)).drop("_u")


def lookup(df: DataFrame, universe: DataFrame, default_sector: str = UNKNOWN) -> DataFrame:
    """Attach sector and name by ticker, with defaults."""
    dim = universe.select("ticker", c("name").alias("_n"), c("sector").alias("_s"))
    joined = df.join(dim, "ticker", "left")
    return joined.withColumns(
        {"name": F.coalesce("_n", "ticker"), "sector": F.coalesce("_s", F.lit(default_sector))}
    ).drop("_n", "_s")
