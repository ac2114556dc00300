"""Expectancy in units of risk: first touch of stop or target on real bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave import panel
from barweave.functions.exprs import clip, div
from barweave.operators.features import calendar_full, full, last_rows, true_range
from barweave.panel import series

c = F.col

# Costs, stop distance and the sweep grid.
COST_ROUND_TRIP = 0.001
RISK_ATR = 1.5
RISK_MIN = 0.01
RISK_MAX = 0.05
MAX_HOLD = 20
RISK_PER_TRADE = 0.01
SWEEP_PROBS = [0.50, 0.525, 0.55, 0.575, 0.60, 0.625, 0.65, 0.70]
SWEEP_RR = [1.5, 2.0]
MAX_MISMATCH = 0.10
MIN_COVERAGE = 0.8
CALENDAR_DAYS_PER_SESSION = 1.45


# --- loading ---------------------------------------------------------------------


def oof_checks(oof: DataFrame, training: DataFrame) -> DataFrame:
    """Row counts that must hold before scored rows are trusted."""
    known = training.select("ticker").distinct().withColumn("_known", F.lit(1))
    return oof.join(known, "ticker", "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c("prob_up").isNull() | c("target").isNull() | c("date").isNull()).alias("n_incomplete"),
        F.count_if(c("_known").isNull()).alias("n_unknown_ticker"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def number_rows(oof: DataFrame) -> DataFrame:
    """Row ids in ticker-major order, the order legacy files were written in."""
    bucket = F.struct("ticker", F.year("date").alias("year"))
    plain = oof.select("ticker", "date", "prob_up", "target")
    return panel.sequence(plain, [], ["ticker", "date"], bucket).withColumnRenamed("seq", "row_id").drop("seg")


def add_blocks(rows: DataFrame, segment_rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """Block id of rows that lost their ticker: a new block when the date steps back."""
    numbered = rows.withColumn("seq", c("row_id"))
    w = Window.partitionBy("seg").orderBy("seq")
    flagged = panel.windowed(
        numbered,
        [lambda d: d.withColumn("_back", (c("date") < F.lag("date").over(w)).cast("int"))],
        back=1,
        rows=segment_rows,
    ).withColumn("_back", F.coalesce("_back", F.lit(0)))
    # segments are carried inside groups of 1,024, and these groups once more
    grouped = flagged.withColumn("_group", F.floor(c("seg") / 1024))
    inside = panel.running(grouped, ["_group"], ["seq"], "seg", block=("sum", "_back"))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # a row for about two million
    before = grouped.groupBy("_group").agg(F.sum("_back").alias("_n")).select("_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return inside.join(before, "_group").withColumn("block", c("block") + c("_before")).drop("_back", "seq", "seg", "_group", "_before")


def block_checks(blocks: DataFrame) -> DataFrame:
    """Rows and distinct dates per block; they agree for a valid block."""
    per_date = blocks.groupBy("block", "date").agg(F.count(F.lit(1)).alias("_k"))
    return per_date.groupBy("block").agg(
        F.sum("_k").alias("n_rows"), F.count(F.lit(1)).alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def _monthly_bits(df: DataFrame, key: str, flag: str, prefix: str) -> DataFrame:
    """Per key and month, one bit per day: which days exist and which are up."""
    bit = F.pow(F.lit(2.0), F.dayofmonth("date")).cast("long")
    return df.groupBy(key, F.trunc("date", "month").alias("_month")).agg(
        F.bit_or(bit).alias(f"{prefix}_days"), F.bit_or(F.when(c(flag) == 1, bit).otherwise(F.lit(0))).alias(f"{prefix}_up")
    )


def match_blocks(blocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Name the ticker of each block by comparing targets with real moves, date by date.

    Candidates are the (few) training tickers. A candidate must cover 80 % of
    the dates; the least mismatch wins, and above 10 % the block stays unnamed.
    Both sides are packed into one bit per day, so a block meets a candidate
    once per month and not once per date.
    """
    up = (F.lead("close").over(series()) > c("close")).cast("int")
    implied = panel.windowed(bars, [lambda d: d.withColumn("_up", up)], ahead=1).where(c("_up").isNotNull())
    candidates = _monthly_bits(implied.withColumnRenamed("ticker", "candidate"), "candidate", "_up", "c")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))
    pairs = _monthly_bits(blocks, "block", "target", "b").join(candidates, "_month")
    both = c("b_days").bitwiseAND(c("c_days"))
    wrong = c("b_up").bitwiseXOR(c("c_up")).bitwiseAND(both)
    scored = (
        pairs.groupBy("block", "candidate")
        .agg(F.sum(F.bit_count(both)).alias("_covered"), F.sum(F.bit_count(wrong)).alias("_wrong"))
        .join(sizes, "block").where((c("_covered") > 0) & (c("_covered") >= MIN_COVERAGE * c("n_rows")))
    )
    miss = (c("_wrong") / c("_covered")).alias("_miss")
    best = scored.groupBy("block").agg(F.min(F.struct(miss, "candidate")).alias("_b"))
    named = F.when(c("_b._miss") <= MAX_MISMATCH, c("_b.candidate"))
    return sizes.join(best, "block", "left").select(
        "block", "n_rows", named.alias("ticker"), F.coalesce(c("_b._miss"), F.lit(1.0)).alias("mismatch")
    )


# --- execution data -----------------------------------------------------------------


def add_execution(max_hold: int = MAX_HOLD):
    """ATR, next open and the bars of the holding window of each decision bar."""

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("_prev", F.lag("close").over(series()))
        df = df.withColumn("_tr", true_range(first_is_null=False))
        path = F.collect_list(F.struct("high", "low", "close")).over(series().rowsBetween(1, max_hold))
        return df.withColumns(
            {
                "atr_t": full(14, F.avg("_tr").over(last_rows(14)), c("_tr")),
                "entry": F.lead("open").over(series()),
                "path": path,
            }
        ).drop("_tr", "_prev")

    return step


def market_trend(market: DataFrame) -> DataFrame:
    """Index close and its 50-row mean by date."""
    return market.select("date", c("close").alias("spy_t"), calendar_full(50, F.avg, "close").alias("spy_sma50_t"))


def attach(oof: DataFrame, bars: DataFrame, vix: DataFrame, market: DataFrame, max_hold: int = MAX_HOLD) -> DataFrame:
    """Scored rows with execution data and market context (exact dates)."""
    back = 14
    exec_rows = panel.windowed(bars, [add_execution(max_hold)], back=back, ahead=max_hold).select(
        "ticker", "date", c("seq").alias("pos_t"), "atr_t", c("close").alias("close_t"), "entry", "path"
    )
    return (
        oof.select("ticker", "date", "prob_up", "target")
        .join(exec_rows, ["ticker", "date"])
        .join(vix.select("date", c("close").alias("vix_t")), "date", "left")
        .join(market_trend(market), "date", "left")
    )


# --- gates ------------------------------------------------------------------------------


def side_for(prob_up: Column, prob_min: float) -> Column:
    """Long, short or null for a symmetric probability gate."""
    return F.when(prob_up >= prob_min, "long").when(prob_up <= F.lit(1.0) - F.lit(prob_min), "short")


def gate_vix(df: DataFrame, vix_max: float) -> DataFrame:
    """Drop decisions under stress; an unknown gauge passes."""
    return df.where(F.coalesce("vix_t", F.lit(0.0)) <= vix_max)


def gate_trend(df: DataFrame) -> DataFrame:
    """Longs need the index above its mean; shorts are not affected."""
    rising = F.coalesce(c("spy_t") > c("spy_sma50_t"), F.lit(False))
    return df.where(rising | (c("side") != "long"))


# --- resolution ---------------------------------------------------------------------------


def entry_levels(df: DataFrame, rr: Column) -> DataFrame:
    """Entry at the next open; stop at a clipped ATR distance; target at rr times the risk."""
    usable = df.where((c("atr_t") > 0) & c("entry").isNotNull())
    risk_pct = clip(F.lit(RISK_ATR) * c("atr_t") / c("close_t"), RISK_MIN, RISK_MAX)
    usable = usable.withColumn("rr_multiple", rr).withColumn("_dist", c("entry") * risk_pct)
    sign = F.when(c("side") == "long", 1.0).otherwise(-1.0)
    return usable.withColumns(
        {
            "risk_pct": risk_pct,
            "sl": c("entry") - sign * c("_dist"),
            "tp": c("entry") + sign * (c("rr_multiple") * c("_dist")),
        }
    ).drop("_dist")


def first_touch(df: DataFrame) -> DataFrame:
    """Result in R, sessions held and outcome of each decision.

    The stop wins when one bar touches both levels; a window without a touch
    closes at its last bar.
    """
    long = c("side") == "long"
    stop = F.transform("path", lambda b: F.when(long, b["low"] <= c("sl")).otherwise(b["high"] >= c("sl")))
    take = F.transform("path", lambda b: F.when(long, b["high"] >= c("tp")).otherwise(b["low"] <= c("tp")))
    df = df.withColumns(
        {"_isl": F.array_position(stop, True), "_itp": F.array_position(take, True), "_risk": F.abs(c("entry") - c("sl"))}
    )
    hit_stop = (c("_isl") > 0) & ((c("_itp") == 0) | (c("_isl") <= c("_itp")))
    outcome = F.when(c("_risk") <= 0, "timeout").when(hit_stop, "sl").when(c("_itp") > 0, "tp").otherwise("timeout")
    df = df.withColumn("outcome", outcome)
    cost = div(F.lit(COST_ROUND_TRIP), div(c("_risk"), c("entry")))
    last = F.element_at("path", -1)["close"]
    gross = div(F.when(long, last - c("entry")).otherwise(c("entry") - last), c("_risk"))
    r = (
        F.when(c("_risk") <= 0, 0.0).when(c("outcome") == "sl", -1.0 - cost)
        .when(c("outcome") == "tp", c("rr_multiple") - cost).otherwise(gross - cost)
    )
    held = (
        F.when(c("_risk") <= 0, 0).when(c("outcome") == "sl", c("_isl")).when(c("outcome") == "tp", c("_itp"))
        .otherwise(F.size("path"))
    )
    return df.withColumns({"r": r, "held": held.cast("int")}).drop("_isl", "_itp", "_risk", "path")


def resolve(attached: DataFrame, rr_multiples: list[float] = SWEEP_RR) -> DataFrame:
    """Outcome of every decision for every target multiple.

    The side of a decision is the same under any probability gate of at least
    one half, so each path is walked once per multiple and reused by all gates.
    """
    sided = attached.withColumn("side", side_for(c("prob_up"), 0.5))
    each = sided.withColumn("_rr", F.explode(F.array(*[F.lit(float(x)) for x in rr_multiples])))
    return first_touch(entry_levels(each, c("_rr")).drop("_rr"))


def into_scenarios(resolved: DataFrame, prob_mins: list[float] = SWEEP_PROBS) -> DataFrame:
    """Copies of each resolved decision, one per probability gate it passes."""
    gates = F.array_compact(
        F.array(*[F.when(side_for(c("prob_up"), p).isNotNull(), F.lit(float(p))) for p in prob_mins])
    )
    return resolved.withColumn("prob_min", F.explode(gates))


# --- portfolio limits -------------------------------------------------------------------------


def _occupy(busy: Column, x: Column) -> Column:
    """Last session taken by a position after seeing decision ``x``."""
    return F.when(busy < x["pos_t"], x["pos_t"] + x["held"]).otherwise(busy)


#: Segments whose exit tables are composed in one row, at each level.
FAN_OUT = 1024


def _after(table: Column, over: Column) -> Column:
    return F.element_at(table, (over + 1).cast("int"))


def _composed(items: Column) -> Column:
    """The exit table of consecutive pieces of a series, each (first, last, exits), as one piece.

    Where a segment between two pieces has no decision, no trade reaches over it.
    """

    def then(acc: Column, x: Column) -> Column:
        meets = acc["last"] == x["first"] - 1
        exits = F.transform(acc["exits"], lambda o: _after(x["exits"], F.when(meets, o).otherwise(F.lit(0).cast("long"))))
        return F.struct(acc["first"].alias("first"), x["last"].alias("last"), exits.alias("exits"))

    return F.aggregate(F.slice(items, 2, FAN_OUT), F.element_at(items, 1), then)


def _overhangs(items: Column, over: Column) -> Column:
    """(first, over) of consecutive pieces: what reaches into each, when ``over`` reaches into the first."""
    head = F.element_at(items, 1)
    start = F.array(F.struct(head["first"].alias("first"), over.alias("over"), head["last"].alias("last"), _after(head["exits"], over).alias("out")))

    def follow(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        over = F.when(before["last"] == x["first"] - 1, before["out"]).otherwise(F.lit(0).cast("long"))
        return F.array_append(acc, F.struct(x["first"].alias("first"), over.alias("over"), x["last"].alias("last"), _after(x["exits"], over).alias("out")))

    return F.transform(F.aggregate(F.slice(items, 2, FAN_OUT), start, follow), lambda x: F.struct(x["first"].alias("first"), x["over"].alias("over")))


def overhangs(exits: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """What reaches into each segment: (*keys, seg, _over). ``exits``: (*keys, seg, _exits), a table of exits by overhang.

    The tables are finite maps, and maps compose in any grouping: up a tree of ``FAN_OUT`` pieces a
    row they become one map for each group, and down the tree the overhang at the start of
    each group gives those inside. No row holds more than ``FAN_OUT`` tables, whatever a series' length
    (three levels reach a thousand million segments).
    """
    seg = c("seg").cast("long")
    pieces = exits.select(*keys, seg.alias("_at"), F.struct(seg.alias("first"), seg.alias("last"), c("_exits").alias("exits")).alias("_piece"))
    tree = []
    for _ in range(levels):
        groups = pieces.groupBy(*keys, F.floor(c("_at") / FAN_OUT).alias("_at")).agg(F.array_sort(F.collect_list("_piece")).alias("_items"))
        tree.append(groups)
        pieces = groups.select(*keys, "_at", _composed(c("_items")).alias("_piece"))
    # nothing reaches into the first group of the highest level: with all levels that is the whole series
    found = tree[-1].withColumn("_over", F.lit(0).cast("long"))
    for level in range(levels - 1, -1, -1):
        each = found.select(*keys, F.explode(_overhangs(c("_items"), c("_over"))).alias("_s")).select(*keys, c("_s.first").alias("_first"), c("_s.over").alias("_over"))
        if not level:
            return each.select(*keys, c("_first").cast("int").alias("seg"), "_over")
        # a group begins at its first segment with decisions
        below = tree[level - 1].withColumn("_first", F.element_at("_items", 1)["first"])
        found = below.join(each, [*keys, "_first"])


def one_position(df: DataFrame, keys: list[str], max_hold: int = MAX_HOLD, rows: int = panel.SEGMENT_ROWS) -> DataFrame:
    """Greedy per ticker: skip decisions made while the last accepted trade is open.

    The history is cut into segments of ``rows`` sessions. A trade reaches at
    most ``max_hold`` sessions into the next segment, so each segment is first
    folded for every possible overhang at its start; composing these small
    tables (``overhangs``) gives the true overhang, and one more fold accepts the decisions. No
    task or row ever holds more than one segment of a ticker, or a bounded number of tables.
    """
    if max_hold >= rows:
        raise ValueError("a segment must be longer than the longest trade")
    on = [*keys, "ticker", "seg"]
    placed = df.withColumn("seg", panel.segment_of(c("pos_t"), rows))
    packed = placed.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("pos_t", "held"))).alias("_items"))
    base = c("seg").cast("long") * rows
    entering = F.sequence(F.lit(0).cast("long"), F.lit(max_hold).cast("long"))
    exits = F.transform(entering, lambda o: F.greatest(F.lit(0), F.aggregate("_items", base + o, _occupy) - base - rows))
    starts = overhangs(packed.select(*on, exits.alias("_exits")), [*keys, "ticker"])

    fresh = F.struct((base + c("_over")).alias("busy"), F.array().cast("array<bigint>").alias("taken"))

    def accept(acc, x):
        free = acc["busy"] < x["pos_t"]
        taken = F.when(free, F.array_append(acc["taken"], x["pos_t"])).otherwise(acc["taken"])
        return F.struct(_occupy(acc["busy"], x).alias("busy"), taken.alias("taken"))

    folded = packed.join(starts, on).select(*on, F.explode(F.aggregate("_items", fresh, accept)["taken"]).alias("pos_t"))
    return placed.join(folded, [*on, "pos_t"], "left_semi").drop("seg")


def max_concurrent(df: DataFrame, keys: list[str], limit: int, one_per_ticker: bool = True, width: int = 16) -> DataFrame:
    """Greedy by (date, ticker): skip while ``limit`` accepted trades are open.

    Order matters across tickers, so each scenario is one ordered pass. Its decisions come in order
    of (date, ticker) through Spark's external sort and stream by; what a pass carries from date to date is
    the calendar exits of the open trades, ``limit`` at most, and until when each ticker that was taken is busy. Of a
    date it looks at decisions, ``width`` at a time, until no slot is free and steps over the rest, so a date with any
    number of decisions costs no more than one with a few. Nothing is collected, cut off or repeated.
    """
    slim = df.select(*keys, "date", "ticker", "pos_t", "held")
    n, per_session = len(keys), CALENDAR_DAYS_PER_SESSION

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scenario, day, opened, busy = None, None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            days = batch.column(n).cast(pa.int32()).to_numpy(zero_copy_only=False)
            names = list(zip(*[batch.column(k).to_pylist() for k in range(n)], strict=True)) if n else None
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = days[1:] != days[:-1]
            if names:
                new[1:] |= np.fromiter((x != y for x, y in zip(names[1:], names[:-1], strict=True)), dtype=bool, count=batch.num_rows - 1)
            starts, taken = np.flatnonzero(new).tolist(), []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = names[a] if names else ()
                if here != scenario:
                    scenario, day, opened, busy = here, None, [], {}
                entry = int(days[a]) + 1
                if day != entry:
                    day, opened = entry, [end for end in opened if end >= entry]
                for at in range(a, b, width):
                    if len(opened) >= limit:
                        break
                    some = [batch.column(n + k).slice(at, min(width, b - at)).to_pylist() for k in (1, 2, 3)]
                    for i, (ticker, pos, hold) in enumerate(zip(*some, strict=True), at):
                        if len(opened) >= limit:
                            break
                        if one_per_ticker and busy.get(ticker, -1) >= pos:
                            continue
                        busy[ticker] = pos + hold
                        opened.append(entry + max(1, int(hold * per_session)))
                        taken.append(i)
            out = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[out.column(k) for k in range(n)], out.column(n + 1), out.column(n + 2)], names=[*keys, "ticker", "pos_t"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.select(*keys, "ticker", "pos_t").schema.fields)
    dealt = slim.repartition(*keys) if keys else slim.coalesce(1)
    accepted = dealt.sortWithinPartitions(*keys, "date", "ticker", "pos_t").mapInArrow(run, kinds)
    return df.join(accepted, [*keys, "ticker", "pos_t"], "left_semi")


# --- measures ----------------------------------------------------------------------------------


def equity(trades: DataFrame, keys: list[str], risk: float = RISK_PER_TRADE) -> DataFrame:
    """Compounded equity in (date, ticker) order, with its running peak (at least 1)."""
    grown = trades.withColumns({"_growth": c("r") * risk + 1, "_day": c("date")})
    curve = panel.compounded(grown, keys, ["date", "ticker"], "_day", "_growth")
    curve = curve.withColumnRenamed("curve", "equity").withColumn("peak", F.greatest("peak", F.lit(1.0)))
    return curve.withColumn("drawdown", div(c("equity") - c("peak"), c("peak"))).drop("_growth", "_day")


def metrics(trades: DataFrame, keys: list[str], risk: float = RISK_PER_TRADE) -> DataFrame:
    """Win rate, profit factor, expectancy and equity measures per key."""
    r = c("r")
    agg = equity(trades, keys, risk).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_gain"),
        F.coalesce(-F.sum(F.when(r <= 0, r)), F.lit(0.0)).alias("_loss"),
        F.avg(r).alias("expectancy_r"),
        ((F.product(r * risk + 1) - 1) * 100).alias("total_return_pct"),
        (F.least(F.min("drawdown"), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        F.avg(r * risk).alias("_mean"),
        F.stddev_pop(r * risk).alias("_sd"),
        F.avg(c("held").cast("double")).alias("avg_hold_days"),
        F.datediff(F.max("date"), F.min("date")).alias("_days"),
    )
    years = F.greatest(c("_days") / 365.25, F.lit(1e-9))
    return agg.select(
        *keys,
        "n_trades",
        "win_rate",
        div(c("_gain"), c("_loss")).alias("profit_factor"),
        "expectancy_r",
        "total_return_pct",
        "max_drawdown_pct",
        F.when(c("_sd") > 0, c("_mean") / c("_sd") * F.sqrt(c("n_trades") / years)).otherwise(0.0).alias("sharpe"),
        "avg_hold_days",
    )


def per_side(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Count, win rate and mean R per side, with outcome counts."""
    return trades.groupBy(*keys, "side").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((c("r") > 0).cast("double")).alias("win_rate"),
        F.avg("r").alias("expectancy_r"),
        *[F.count_if(c("outcome") == o).alias(f"n_{o}") for o in ("tp", "sl", "timeout")],
    )


def benchmark(market: DataFrame, first: Column, last: Column) -> DataFrame:
    """Buy and hold of the index between two dates (more than 50 rows).

    One row per day, so the ordered windows are bounded by the calendar.
    """
    held = market.where((c("date") >= first) & (c("date") <= last))
    w = Window.orderBy("date")
    rows = held.select(
        "date",
        (c("close") / F.first("close").over(w)).alias("norm"),
        (div(c("close"), F.lag("close").over(w)) - 1).alias("ret"),
    ).withColumn("dd", c("norm") / F.max("norm").over(w) - 1)
    years = F.greatest(F.datediff(last, first) / 365.25, F.lit(1e-9))
    agg = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("norm", "date").alias("_end"),
        (F.min("dd") * 100).alias("max_drawdown_pct"),
        (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"),
    )
    return agg.where(c("n") > 50).select(
        "n",
        ((c("_end") - 1) * 100).alias("total_return_pct"),
        ((F.pow(c("_end"), 1 / years) - 1) * 100).alias("cagr_pct"),
        "max_drawdown_pct",
        "sharpe",
    )


def thin_equity(curve: DataFrame, keys: list[str], points: int = 400) -> DataFrame:
    """Every n-th point of the equity curve, so about ``points`` remain per key."""
    plain = curve.select(*keys, "date", "ticker", "equity")
    numbered = panel.sequence(plain, keys, ["date", "ticker"], c("date")).drop("seg")
    sizes = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = numbered.join(sizes, keys) if keys else numbered.withColumn("_n", sizes.scalar())
    # the curve starts with the initial capital at index 0
    stride = F.greatest(F.lit(1), F.floor((c("_n") + 1) / points))
    return joined.where(c("seq") % stride == 0).drop("_n")
