"""Forward-only walk-forward splits with a purge gap and an embargo."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Longest look-back of the features, buffer, smallest test window.
PURGE_ROWS = 60
EMBARGO_ROWS = 5
MIN_TEST_ROWS = 20


@dataclass(frozen=True)
class Geometry:
    """Equal test windows anchored at the end; training is all that lies before the gap."""

    n_splits: int = 5
    gap: int = PURGE_ROWS
    embargo: int = EMBARGO_ROWS

    def __post_init__(self):
        if self.n_splits < 2:
            raise ValueError("at least two folds are needed")
        if self.gap < 0 or self.embargo < 0:
            raise ValueError("gap and embargo must not be negative")

    @property
    def buffer(self) -> int:
        return self.gap + self.embargo

    def test_rows(self, n: Column) -> Column:
        return F.floor((n - F.floor(n / 10) - self.buffer) / F.lit(self.n_splits))


def verdict(n: Column, g: Geometry) -> Column:
    """Why a series of ``n`` rows can or cannot be split."""
    return F.when(n <= 0, "empty").when(g.test_rows(n) < MIN_TEST_ROWS, "test window too small").otherwise("ok")


def check(n: int, g: Geometry) -> None:
    """Raise when ``n`` rows are too few."""
    test = (n - n // 10 - g.buffer) // g.n_splits
    if n <= 0 or test < MIN_TEST_ROWS:
        raise ValueError(f"{n} rows are too few for {g.n_splits} folds with a buffer of {g.buffer}")


def bounds(sizes: DataFrame, g: Geometry) -> DataFrame:
    """One row per fold from a frame with a row count ``n`` per series.

    Rows are numbered from 1: train is seq <= train_end, test is
    test_start < seq <= test_end. Series that are too short give no fold.
    """
    ok = sizes.where(verdict(c("n"), g) == "ok").withColumn("_test", g.test_rows(c("n")))
    folds = ok.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(g.n_splits - 1))))
    start = c("n") - (F.lit(g.n_splits) - c("fold")) * c("_test")
    return folds.withColumns(
        {"test_start": start, "test_end": start + c("_test"), "train_end": start - g.buffer}
    ).drop("_test")


def _roles(ranked: DataFrame, folds: DataFrame, on: list[str], rank: str) -> DataFrame:
    """Ranked rows with their role in every fold (a handful of folds per series)."""
    role = F.when(c(rank) <= c("train_end"), "train").when(
        (c(rank) > c("test_start")) & (c(rank) <= c("test_end")), "test"
    )
    spec = F.struct("fold", "train_end", "test_start", "test_end")
    packed = folds.groupBy(*on).agg(F.collect_list(spec).alias("_folds"))  # n_splits entries
    joined = ranked.join(packed, on) if on else ranked.withColumn("_folds", packed.scalar())
    return (
        joined.withColumn("_f", F.explode("_folds"))
        .select(*ranked.columns, "_f.*")
        .withColumn("role", role)
        .where(c("role").isNotNull())
        .drop("train_end", "test_start", "test_end")
    )


def serial_folds(bars: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """Folds inside each ticker's own history."""
    sizes = bars.groupBy("ticker").agg(F.max("seq").alias("n"))
    return _roles(bars, bounds(sizes, g), ["ticker"], "seq")


def date_folds(bars: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """(date, fold, role) over the distinct dates; bounded by the calendar."""
    dates = bars.select("date").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("date")).cast("long"))
    sizes = dates.agg(F.count(F.lit(1)).alias("n"))
    return _roles(dates, bounds(sizes, g), [], "_rank").drop("_rank")


def panel_folds(bars: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """Folds over dates: every ticker of a date is on the same side."""
    return bars.join(date_folds(bars, g), "date")


def coverage(folds: DataFrame) -> DataFrame:
    """Extent of each fold side, to prove windows are contiguous and disjoint."""
    per_date = folds.groupBy("fold", "role", "date").agg(F.count(F.lit(1)).alias("k"))
    return per_date.groupBy("fold", "role").agg(
        F.sum("k").alias("n_rows"),
        F.count(F.lit(1)).alias("n_dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
