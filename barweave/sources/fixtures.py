"""Market-shaped tables derived from the order tables.

Bars are an aggregate of ``lineitem`` joined to ``part`` (one row per brand and
shipping day); the index comes from all of ``lineitem`` and the volatility
gauge from ``orders``. All arithmetic is on integers and divided once, so
every engine produces the same doubles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave import panel
from barweave.session import written

c = F.col


def _percent(name: str):
    return F.round(c(name) * 100).cast("long")


def _delta(total: str = "disc_sum"):
    return F.floor(F.lit(320.0) * c(total) / c("n")).cast("long") - 1600


class Inputs:
    """Tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def store(self, name: str, build) -> DataFrame:
        """A derived table, written once per application."""
        return written(self.spark, f"{self.sf_dir}#{name}", build)

    # --- bars -------------------------------------------------------------

    def build_bars(self) -> DataFrame:
        part = self.table("part").select("p_partkey", c("p_brand").alias("ticker"))
        day = (
            self.table("lineitem")
            .select("l_partkey", c("l_shipdate").cast("date").alias("date"), _percent("l_discount").alias("disc"),
                    _percent("l_tax").alias("tax"), c("l_quantity").cast("long").alias("q"))
            .join(part, c("l_partkey") == c("p_partkey"))
            .groupBy("ticker", "date")
            .agg(F.sum("disc").alias("disc_sum"), F.sum("tax").alias("tax_sum"), F.max("tax").alias("tax_hi"),
                 F.min("tax").alias("tax_lo"), F.sum("q").alias("qty"), F.count(F.lit(1)).alias("n"))
            .withColumns({"delta": _delta(), "year": F.year("date"), "one": F.lit(1)})
        )
        day = panel.running(day, ["ticker"], ["date"], "year", walk=("sum", "delta"), seq=("sum", "one"))
        jump = (
            F.when(c("qty") % 97 == 0, 6000).when(c("qty") % 89 == 0, 3000).otherwise(0)
        )
        close_c = c("walk") + 100000
        open_c = close_c - c("delta") + F.floor(F.lit(160.0) * c("tax_sum") / c("n")).cast("long") - 640 + jump
        cents = day.withColumns({"close_c": close_c, "open_c": open_c})
        return cents.select(
            "ticker",
            "date",
            (c("open_c") / 100.0).alias("open"),
            ((F.greatest("open_c", "close_c") + c("tax_hi") * 150) / 100.0).alias("high"),
            ((F.least("open_c", "close_c") - (8 - c("tax_lo")) * 150) / 100.0).alias("low"),
            (c("close_c") / 100.0).alias("close"),
            (c("qty") * 1000).cast("double").alias("volume"),
            ((300 + F.floor(F.lit(8.0) * c("qty") / c("n")).cast("long")) / 1000.0).alias("prob_up"),
            c("seq").cast("long").alias("seq"),
        ).withColumn("seg", panel.segment_of(c("seq")))

    @cached_property
    def bars(self) -> DataFrame:
        return self.store("bars", self.build_bars)

    # one row per calendar day each, so the ordered window has a bounded input

    def build_market(self) -> DataFrame:
        day = (
            self.table("lineitem")
            .select(c("l_shipdate").cast("date").alias("date"), _percent("l_discount").alias("disc"))
            .groupBy("date")
            .agg(F.sum("disc").alias("disc_sum"), F.count(F.lit(1)).alias("n"))
        )
        walk = F.sum(_delta()).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
        return day.select("date", ((walk + 100000) / 100.0).alias("close"))

    @cached_property
    def market(self) -> DataFrame:
        return self.store("market", self.build_market)

    def build_vix(self) -> DataFrame:
        urgent = F.substring("o_orderpriority", 1, 1).isin("1", "2").cast("long")
        return (
            self.table("orders")
            .select(c("o_orderdate").cast("date").alias("date"), urgent.alias("u"))
            .groupBy("date")
            .agg(F.sum("u").alias("u"), F.count(F.lit(1)).alias("n"))
            .select("date", ((F.floor(F.lit(3000.0) * c("u") / c("n")).cast("long") + 1000) / 100.0).alias("close"))
        )

    @cached_property
    def vix(self) -> DataFrame:
        return self.store("vix", self.build_vix)

    # --- other views --------------------------------------------------------

    @cached_property
    def features(self) -> DataFrame:
        from barweave.operators.features import compute_all

        return self.store("features", lambda: compute_all(self.bars, self.market, self.vix))

    @cached_property
    def oof(self) -> DataFrame:
        """Scored bars with a known next close."""
        from barweave.operators.targets import add_direction

        return (
            panel.windowed(self.bars, [add_direction(keep_last=False)], ahead=1)
            .where(c("target").isNotNull())
            .select("ticker", "date", "prob_up", "target", "seq")
        )

    @cached_property
    def universe(self) -> DataFrame:
        number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
        return (
            self.table("part")
            .select(c("p_brand").alias("ticker"))
            .distinct()
            .select(
                "ticker",
                c("ticker").alias("name"),
                (number % 5).cast("string").alias("sector"),
                F.when(number % 2 == 0, "NY").otherwise("SF").alias("exchange"),
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        tier = F.element_at(F.array(F.lit("pro"), F.lit("free"), F.lit("")), (c("c_custkey") % 3 + 1).cast("int"))
        return self.table("customer").select(
            c("c_custkey").alias("user_id"),
            F.concat(F.lower("c_name"), F.lit("@x.test")).alias("email"),
            F.when(c("c_custkey") % 2 == 0, c("c_custkey").cast("string")).otherwise("").alias("chat_id"),
            tier.alias("tier"),
        )

    @cached_property
    def terciles(self) -> DataFrame:
        """Realised volatility and its regime label for every bar."""
        from barweave.operators.regime import vol_terciles

        return self.store("terciles", lambda: vol_terciles(self.bars).select("ticker", "date", "realized_vol", "vol_regime"))

    @cached_property
    def signals(self) -> DataFrame:
        """A graded signal for every bar, with volatility-based levels."""
        from barweave.operators.signals import signal_history

        return self.store("signals", lambda: signal_history(self.bars, self.vix))
