"""Targets and training-set preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import div
from barweave.panel import series

c = F.col


def add_direction(keep_last: bool = True):
    """1 when the next close is higher, else 0.

    The last bar of a ticker has no next close: it counts as 0 by default, as a
    comparison with a missing value is false; ``keep_last=False`` makes it null.
    """
    up = (F.lead("close").over(series()) > c("close")).cast("int")
    return lambda df: df.withColumn("target", F.coalesce(up, F.lit(0)) if keep_last else up)


def add_next_return(df: DataFrame) -> DataFrame:
    return df.withColumn("target_return", div(F.lead("close").over(series()), c("close")) - 1)


def add_return_at_5(df: DataFrame) -> DataFrame:
    """One-bar return five bars ahead, and the true five-bar return beside it."""
    at5 = F.lead("close", 5).over(series())
    return df.withColumns(
        {
            "target_return_5d": div(at5, F.lead("close", 4).over(series())) - 1,
            "target_return_5bar": div(at5, c("close")) - 1,
        }
    )


def drop_incomplete(df: DataFrame, features: list[str], target: str | None = "target") -> DataFrame:
    """Keep rows whose features and target are all present."""
    return df.dropna(how="any", subset=features + ([target] if target else []))


def feature_report(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, keep): a feature is dropped when constant or empty. One pass."""
    flags = df.agg(*[F.coalesce(F.min(f) < F.max(f), F.lit(False)).alias(f) for f in features])
    return flags.unpivot([], features, "feature", "keep")


def drop_constant(df: DataFrame, features: list[str]) -> list[str]:
    """Names of the informative features (one small row reaches the driver)."""
    return [r["feature"] for r in feature_report(df, features).collect() if r["keep"]]


def subset(df: DataFrame, requested: list[str]) -> list[str]:
    return [f for f in requested if f in df.columns]


def ticker_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("target").cast("long").alias("n_up"),
        F.sum(1 - c("target")).cast("long").alias("n_down"),
    )


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight n/(2·n_c) per label, and the up weight n_down/n_up."""
    counts = df.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # two rows
    up = F.greatest(F.sum(F.when(c("target") == 1, c("n")).otherwise(0)).over(everything), F.lit(1))
    down = F.greatest(F.sum(F.when(c("target") == 0, c("n")).otherwise(0)).over(everything), F.lit(1))
    return counts.select(
        "target",
        "n",
        (F.sum("n").over(everything) / (2.0 * F.greatest(c("n"), F.lit(1)))).alias("weight"),
        (down / up).alias("positive_weight"),
    )


def split_temporal(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Mark the first (1 - test_size) of the rows, in (date, ticker) order, as train."""
    ranked = panel.sequence(df.drop("seq", "seg"), [], ["date", "ticker"], c("date"))
    cut = F.floor(df.agg(F.count(F.lit(1))).scalar() * F.lit(1 - test_size))
    return ranked.withColumn("role", F.when(c("seq") <= cut, "train").otherwise("test")).drop("seg")
