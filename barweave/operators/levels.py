"""Support and resistance zones, stops and targets."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import div, half_up
from barweave.panel import series

c = F.col

ZONE_GAP = 0.01
STOP_BUFFER_ATR = 0.5
STOP_DEFAULT_ATR = 1.5
MIN_REWARD_RISK = 2.0
RISK_BUDGET = 0.01


def add_pivots(left: int = 5, right: int = 5):
    """Flag local extremes: none of the bars around is beyond, and enough of them are strictly inside.

    Each neighbour is one comparison over the same sort; no row carries its neighbours' values along.
    """

    def step(df: DataFrame) -> DataFrame:
        w = series()
        around = lambda name: [*(F.lag(name, k).over(w) for k in range(1, left + 1)), *(F.lead(name, k).over(w) for k in range(1, right + 1))]
        beyond = {"high": lambda x: x <= c("high"), "low": lambda x: x >= c("low")}
        inside = {"high": lambda x: x < c("high"), "low": lambda x: x > c("low")}
        flags = {}
        for name in ("high", "low"):
            others = around(name)
            # a missing neighbour makes the first comparison null: a bar at the end of its series is no extreme
            extreme = reduce(and_, [beyond[name](x) for x in others])
            enough = reduce(add, [inside[name](x).cast("int") for x in others]) >= left
            flags[f"pivot_{name}"] = F.coalesce(extreme & enough, F.lit(False))
        return df.withColumns(flags)

    return step


def pivots(bars: DataFrame, left: int = 5, right: int = 5, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    return panel.windowed(bars, [add_pivots(left, right)], back=left, ahead=right, rows=rows)


def zones(pivoted: DataFrame, tolerance: float = ZONE_GAP) -> DataFrame:
    """Merge pivot prices into zones; a new zone starts after a gap over ``tolerance``.

    Equal prices are counted first. The distinct prices of a ticker are cut by the
    logarithm of the price, so no task sorts them all: gaps are measured inside a
    step and against the top of the step before, and zones are numbered by a running
    sum over the steps (a few thousand at most, as prices span few magnitudes).
    """
    prices = pivoted.select(
        "ticker",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(c("pivot_low"), F.struct(F.lit("support").alias("kind"), c("low").alias("price"))),
                    F.when(c("pivot_high"), F.struct(F.lit("resistance").alias("kind"), c("high").alias("price"))),
                )
            )
        ).alias("p"),
    ).select("ticker", "p.*")
    distinct = prices.groupBy("ticker", "kind", "price").agg(F.count(F.lit(1)).alias("k"))
    keys = ["ticker", "kind"]
    step = F.when(c("price") > 0, F.floor(F.log("price") / 0.01)).otherwise(F.lit(-(1 << 40)))
    stepped = distinct.withColumn("_step", step)
    tops = stepped.groupBy(*keys, "_step").agg(F.max("price").alias("_top"))
    below = tops.select(*keys, "_step", F.lag("_top").over(Window.partitionBy(*keys).orderBy("_step")).alias("_below"))
    inside = F.lag("price").over(Window.partitionBy(*keys, "_step").orderBy("price"))
    gaps = stepped.withColumn("_prev", inside).join(below, [*keys, "_step"])
    prev = F.coalesce("_prev", "_below")
    starts = F.when(F.abs(c("price") - prev) / prev <= tolerance, 0).otherwise(1)
    marked = panel.running(gaps.withColumn("_new", starts), keys, ["price"], "_step", zone=("sum", "_new"))
    return marked.groupBy("ticker", "kind", "zone").agg(
        (F.sum(c("price") * c("k")) / F.sum("k")).alias("level"), F.sum("k").alias("n_pivots")
    )


def zone_arrays(zoned: DataFrame) -> DataFrame:
    """Ascending ``supports`` and ``resistances`` per ticker.

    Zones lie at least one tolerance apart, so the arrays grow with the log of
    the price range only.
    """
    pick = lambda kind: F.array_sort(F.collect_list(F.when(c("kind") == kind, c("level"))))
    return zoned.groupBy("ticker").agg(pick("support").alias("supports"), pick("resistance").alias("resistances"))


def side_sign(side: Column) -> Column:
    return F.when(side == "long", 1.0).otherwise(-1.0)


def add_levels(df: DataFrame) -> DataFrame:
    """Entry, stop, two targets and size for ``side``, ``price`` and ``atr``.

    Expects ascending ``supports`` / ``resistances``. Everything is null when
    the ATR is missing or not positive.
    """
    long = c("side") == "long"
    sign = side_sign(c("side"))
    atr, price = F.when(c("atr") > 0, c("atr")), c("price")
    below = F.array_max(F.filter("supports", lambda s: s < price))
    above = F.array_min(F.filter("resistances", lambda r: r > price))
    df = df.withColumns({"entry": F.when(atr.isNotNull(), price), "sgn": sign, "_atr": atr})
    near = F.when(long, below).otherwise(above)
    stop = F.when(near.isNotNull(), near - sign * STOP_BUFFER_ATR * atr).otherwise(price - sign * STOP_DEFAULT_ATR * atr)
    df = df.withColumn("stop_loss", stop).withColumn("risk", F.abs(c("entry") - c("stop_loss")))
    df = df.withColumns(
        {
            "tp1_raw": c("entry") + c("sgn") * F.greatest(c("_atr"), c("risk")),
            "tp2_raw": c("entry") + c("sgn") * F.greatest(2 * c("_atr"), 2 * c("risk")),
            "_walls": F.when(long, c("resistances")).otherwise(c("supports")),
        }
    )

    def walls_before(target: str) -> Column:
        return F.filter(
            "_walls",
            lambda x: (c("sgn") * (x - c("entry")) > 0) & (c("sgn") * (x - c("entry")) < c("sgn") * (c(target) - c("entry"))),
        )

    far = lambda arr: F.when(long, F.array_max(arr)).otherwise(F.array_min(arr))
    close_by = lambda arr: F.when(long, F.array_min(arr)).otherwise(F.array_max(arr))
    df = df.withColumns({"tp1_cap": far(walls_before("tp1_raw")), "tp2_wall": close_by(walls_before("tp2_raw"))})
    df = df.withColumn("tp1_level", F.coalesce(c("tp1_cap"), c("tp1_raw")))
    return _pack_targets(df).drop("_atr", "_walls")


def _target(name: str, level: str) -> Column:
    move = div(c("sgn") * (c(level) - c("entry")), c("entry")) * 100
    return F.struct(
        F.lit(name).alias("name"),
        half_up(c(level), 2).alias("price"),
        move.alias("move_pct"),
        div(F.abs(c(level) - c("entry")), c("risk")).alias("rr"),
    )


def _pack_targets(df: DataFrame) -> DataFrame:
    """Targets as an array of structs; the last one pays at least twice the risk."""
    first, second = _target("TP1", "tp1_level"), _target("TP2", "tp2_raw")
    df = df.withColumns({"_t1": first, "_t2": second})
    same = c("_t1.price") == c("_t2.price")
    df = df.withColumn("_last", F.when(same, c("_t1")).otherwise(c("_t2")))
    df = df.withColumn("_rr", div(F.abs(c("_last.price") - c("entry")), c("risk")))
    forced_level = c("entry") + c("sgn") * MIN_REWARD_RISK * c("risk")
    low = F.coalesce(c("_rr") + 1e-9 < MIN_REWARD_RISK, F.lit(False))
    forced = F.struct(
        c("_last.name").alias("name"),
        half_up(forced_level, 2).alias("price"),
        (div(c("sgn") * (forced_level - c("entry")), c("entry")) * 100).alias("move_pct"),
        F.lit(MIN_REWARD_RISK).alias("rr"),
    )
    last = F.when(low, forced).otherwise(c("_last"))
    targets = F.when(c("entry").isNull(), F.array().cast("array<struct<name:string,price:double,move_pct:double,rr:double>>"))
    df = df.withColumns(
        {
            "rr_forced": low,
            "take_profits": targets.when(same, F.array(last)).otherwise(F.array(c("_t1"), last)),
            "risk_reward": F.when(low, MIN_REWARD_RISK).otherwise(c("_rr")),
            "base_size_pct": F.least(F.lit(100.0), div(F.lit(RISK_BUDGET), div(c("risk"), c("entry"))) * 100),
        }
    )
    return df.drop("_t1", "_t2", "_last", "_rr")


def tail(levels: Column, n: int = 4) -> Column:
    """The last ``n`` entries."""
    return F.when(F.size(levels) > n, F.slice(levels, -n, n)).otherwise(levels)


def nearest(levels: Column, price: Column, n: int = 4) -> Column:
    """The ``n`` entries closest to ``price``, ascending."""
    ranked = F.array_sort(F.transform(levels, lambda v: F.struct(F.abs(v - price).alias("d"), v.alias("v"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda s: s["v"]))
