"""Exponential recurrences as window sums.

e_t = (1-a)·e_{t-1} + a·x_t with e_0 = s has the closed form
e_t = q^t · (s + Σ_{1≤i≤t} a·x_i·q^-i), q = 1-a, which is one running sum. The
exponent grows with t, so it is only safe inside a bounded segment: with 2,560
rows per window the steepest decay used (span 9) reaches e^571, below the
double limit of e^709.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barweave.panel import series


#: Exponents beyond this would leave the double range within a window.
MOST_EXPONENT = 690.0
#: What is left of a seed after the warm-up, as an exponent: below double precision.
FORGOTTEN = 37.0


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def warmup_rows(slowest: float) -> int:
    """Rows after which an average with this factor, or a faster one, has forgotten its seed."""
    return math.ceil(FORGOTTEN / -math.log1p(-slowest))


def longest_window(steepest: float) -> int:
    """Rows of the longest window in which an average with this factor doesn't overflow."""
    return int(MOST_EXPONENT / -math.log1p(-steepest))


def check_window(rows: int, steepest: float) -> None:
    """Refuse windows of ``rows`` rows in which an average with this factor would overflow."""
    most = longest_window(steepest)
    if rows > most:
        raise ValueError(f"a window of {rows} rows is too long for a decay factor of {steepest:.4g}: at most {most}; choose fewer rows a segment")


_seen: ContextVar[set[float] | None] = ContextVar("factors", default=None)


@contextmanager
def factors():
    """The decay factors of all averages that are written down in here."""
    token = _seen.set(found := set())
    try:
        yield found
    finally:
        _seen.reset(token)


def decayed_mean(x: Column, alpha: float, start: Column, seed: Column | None = None, keys=("ticker",)) -> Column:
    """Exponential mean of ``x`` over the rows with ``seq >= start``.

    The first value is ``seed`` (default: ``x``) at ``seq == start``.
    """
    if (seen := _seen.get()) is not None:
        seen.add(alpha)
    log_q = math.log(1.0 - alpha)
    i = (F.col("seq") - start).cast("double")
    seed = x if seed is None else seed
    term = F.when(i == 0, seed).when(i > 0, F.lit(alpha) * x * F.exp(-i * F.lit(log_q)))
    total = F.sum(term).over(series(keys).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(i >= 0, F.exp(i * F.lit(log_q)) * total)


def ema(x: Column, span: int, start: Column | None = None, keys=("ticker",)) -> Column:
    start = F.col("_first") if start is None else start
    return decayed_mean(x, span_alpha(span), start, keys=keys)


def wilder(x: Column, n: int, start: Column, seed: Column, keys=("ticker",)) -> Column:
    """Wilder average, seeded with ``seed`` at ``start``."""
    return decayed_mean(x, 1.0 / n, start, seed, keys=keys)
