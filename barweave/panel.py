"""Skew-proof windows over a panel of series.

A panel holds many series (one per key) ordered by time. A window partitioned
by the key alone puts a whole series into one task, which fails when one key
holds a large share of the rows. The helpers here cut every series into
segments of a fixed number of rows, so each task sees a bounded piece:

* ``sequence``  numbers the rows of a series in two levels (count per time
  bucket, then rank inside the bucket) and derives the segment id;
* ``with_halo`` copies the last rows of a segment to the next one (and the
  first rows to the previous one) so bounded frames are exact at the seams;
* ``running``   computes cumulative aggregates as local prefix + carry of the
  earlier segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 2048
# Rows replayed before a segment so exponential recurrences forget their seed:
# the slowest decay used is (25/27) per row, and 512 rows leave e^-39 of it.
WARMUP_ROWS = 512

_UNB = Window.unboundedPreceding
_KINDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "max": (F.max, F.greatest, None),
    "min": (F.min, F.least, None),
    # most recent non-null value
    "last": (lambda c: F.last(c, ignorenulls=True), lambda local, carry: F.coalesce(local, carry), None),
}


def running(df: DataFrame, keys: list[str], order: list, bucket: str, **outputs) -> DataFrame:
    """Cumulative aggregates along ``order`` within ``keys``.

    ``outputs`` maps a new column to ``(kind, column)`` with kind one of sum,
    product, max, min, last. ``bucket`` is a column that never decreases along
    ``order``; rows of one bucket form one task, and the buckets of a key are
    joined by their (few) partial results.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    local_w = Window.partitionBy(*keys, bucket).orderBy(*order)
    local_rows = local_w.rowsBetween(_UNB, 0)
    carry_rows = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(_UNB, -1)

    totals_aggs, carries = [], []
    for name, (kind, column) in outputs.items():
        fn = _KINDS[kind][0]
        if kind == "last":
            # the group result must follow the row order, so pick by max(order)
            totals_aggs.append(
                F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias(f"_t_{name}")
            )
        else:
            totals_aggs.append(fn(column).alias(f"_t_{name}"))
        carries.append(fn(F.col(f"_t_{name}")).over(carry_rows).alias(f"_c_{name}"))
    on = [*keys, bucket]
    carry = df.groupBy(*on).agg(*totals_aggs).select(*on, *carries)

    local = df.select("*", *[_KINDS[k][0](c).over(local_rows).alias(n) for n, (k, c) in outputs.items()])
    joined = local.join(carry, on, "left")
    combined = []
    for name, (kind, _) in outputs.items():
        _, combine, neutral = _KINDS[kind]
        carried: Column = F.col(f"_c_{name}")
        if neutral is not None:
            carried = F.coalesce(carried, F.lit(neutral))
            local_value = F.coalesce(F.col(name), F.lit(neutral))
        else:
            local_value = F.col(name)
        combined.append(combine(local_value, carried).alias(name))
    return joined.select(*df.columns, *combined)


def compounded(df: DataFrame, keys: list[str], order: list, bucket: str, growth: str) -> DataFrame:
    """Add ``curve``, the running product of ``growth``, and ``peak``, its running maximum.

    Both come from one local pass and one carry per bucket; ``growth`` must be
    positive, so scaling by the carry keeps the order of the local maxima.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    on = [*keys, bucket]
    rows = Window.partitionBy(*on).orderBy(*order).rowsBetween(_UNB, 0)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(_UNB, -1)
    local = df.withColumn("_p", F.product(growth).over(rows)).withColumn("_m", F.max("_p").over(rows))
    totals = local.groupBy(*on).agg(F.max_by("_p", F.struct(*order)).alias("_tp"), F.max("_m").alias("_tm"))
    start = totals.withColumn("_scale", F.coalesce(F.product("_tp").over(earlier), F.lit(1.0)))
    carry = start.withColumn("_high", F.max(F.col("_scale") * F.col("_tm")).over(earlier)).select(*on, "_scale", "_high")
    scale = F.col("_scale")
    return local.join(carry, on).select(
        *df.columns, (F.col("_p") * scale).alias("curve"), F.greatest(F.col("_m") * scale, "_high").alias("peak")
    )


def sequence(
    df: DataFrame,
    keys: list[str] = ("ticker",),
    order: list = ("date",),
    bucket: Column | None = None,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``seq`` (1, 2, … per key) and ``seg`` (segment id) columns."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    bucket = F.year("date") if bucket is None else bucket
    b = df.withColumn("_bucket", bucket)
    on = [*keys, "_bucket"]
    offsets = (
        b.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *on,
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(_UNB, -1)),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    ranked = b.withColumn("_rank", F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    seq = (F.col("_offset") + F.col("_rank")).cast("long")
    return (
        ranked.join(offsets, on)
        .select(*df.columns, seq.alias("seq"))
        .withColumn("seg", segment_of(F.col("seq"), rows))
    )


def segment_of(seq: Column, rows: int = SEGMENT_ROWS) -> Column:
    return F.floor((seq - 1) / F.lit(rows)).cast("int")


def with_halo(df: DataFrame, back: int = 0, ahead: int = 0, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Place each row in its segment and, near a seam, in the neighbour too.

    Adds ``seg`` (the segment to window over) and ``_home``; ``core`` drops the
    copies again. ``_first`` is the first ``seq`` present in the segment.
    """
    if back > rows or ahead > rows:
        raise ValueError("the halo must not be longer than a segment")
    pos = (F.col("seq") - 1) % F.lit(rows)
    home = segment_of(F.col("seq"), rows)
    places = F.array_compact(
        F.array(
            home,
            F.when(pos >= rows - back, home + 1) if back else F.lit(None).cast("int"),
            F.when((pos < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("int"),
        )
    )
    out = df.withColumn("_home", home).withColumn("seg", F.explode(places))
    first = F.greatest(F.lit(1), F.col("seg").cast("long") * rows - back + 1)
    return out.withColumn("_first", first)


def core(df: DataFrame) -> DataFrame:
    """Drop the halo copies."""
    return df.where(F.col("seg") == F.col("_home")).drop("_home", "_first")


def windowed(df: DataFrame, steps: list, back: int = 0, ahead: int = 0, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Run column-adding ``steps`` over segments with a halo, in one shuffle."""
    return core(reduce(lambda d, step: step(d), steps, with_halo(df, back, ahead, rows)))


def series(keys: list[str] = ("ticker",)) -> "Window":
    """Row order inside one segment of one series."""
    return Window.partitionBy(*keys, "seg").orderBy("seq")


def last_rows(n: int, keys: list[str] = ("ticker",)) -> "Window":
    return series(keys).rowsBetween(-(n - 1), 0)


def full(n: int, value: Column, present: Column) -> Column:
    """``value`` only when the last ``n`` rows all hold a value in ``present``."""
    return F.when(F.count(present).over(last_rows(n)) == n, value)


def tail(df: DataFrame, rows: int = 2 * WARMUP_ROWS) -> DataFrame:
    """The last ``rows`` rows of each ticker, with the ticker's row count as ``n_bars``.

    Enough to compute any bounded frame or recurrence on the newest row, so a
    scan of the latest state need not window over the whole history.
    """
    lengths = df.groupBy("ticker").agg(F.max("seq").alias("n_bars"))
    return df.join(lengths, "ticker").where(F.col("seq") > F.col("n_bars") - rows)


def newest(df: DataFrame) -> DataFrame:
    """The last row of each ticker of a frame cut by ``tail``."""
    return df.where(F.col("seq") == F.col("n_bars")).drop("n_bars")


def exact_quantiles(df: DataFrame, keys: list[str], column: str, probs: list[float], bucket: Column) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column ``q0``, ``q1``, ….

    A histogram over ``bucket`` (which must not decrease with the value) tells
    which buckets hold the wanted ranks; only their rows are sorted.
    """
    on = [*keys, "_bucket"]
    present = df.where(F.col(column).isNotNull()).select(*keys, column, bucket.alias("_bucket"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(_UNB, 0)
    hist = (
        present.groupBy(*on).agg(F.count(F.lit(1)).alias("_k"))
        .withColumns({"_cum": F.sum("_k").over(by_bucket), "_n": F.sum("_k").over(Window.partitionBy(*keys))})
        .withColumn("_before", F.col("_cum") - F.col("_k"))
    )
    low = [F.floor((F.col("_n") - 1) * F.lit(p)) + 1 for p in probs]
    high = [F.least(r + 1, F.col("_n")) for r in low]
    holds = [(r > F.col("_before")) & (r <= F.col("_cum")) for r in [*low, *high]]
    wanted = hist.where(reduce(lambda a, b: a | b, holds)).select(*on, "_before", "_n")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*on).orderBy(column))
    ranked = present.join(wanted, on).withColumn("_rank", rank)
    aggs = []
    for i, p in enumerate(probs):
        aggs += [
            F.max(F.when(F.col("_rank") == low[i], F.col(column))).alias(f"_lo{i}"),
            F.max(F.when(F.col("_rank") == high[i], F.col(column))).alias(f"_hi{i}"),
            F.max((F.col("_n") - 1) * F.lit(p) - low[i] + 1).alias(f"_f{i}"),
        ]
    between = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *[between(i).alias(f"q{i}") for i in range(len(probs))])
