"""Segmented windows must equal whole-series windows."""

import numpy as np
import pandas as pd
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barweave import panel
from barweave.operators import expectancy, features, levels


def _sorted(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_sequence_numbers_rows_over_buckets(make_bars):
    got = _sorted(make_bars(walk("A", 600), walk("B", 300, seed=3)), "ticker", "date")
    assert got.groupby("ticker").seq.apply(list).loc["A"] == list(range(1, 601))
    assert got.groupby("ticker").seq.max().to_dict() == {"A": 600, "B": 300}


@pytest.mark.parametrize("kind,fn", [("sum", "cumsum"), ("max", "cummax"), ("min", "cummin"), ("product", "cumprod")])
def test_running_equals_pandas(spark, kind, fn):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400), "i": np.arange(400), "x": rng.uniform(0.9, 1.1, 400)})
    df = spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("i") / 37))
    got = _sorted(panel.running(df, ["k"], ["i"], "b", y=(kind, "x")), "i")
    want = getattr(pdf.groupby("k").x, fn)()
    assert np.allclose(got.y, want)


def test_running_last_carries_over_empty_buckets(spark):
    pdf = pd.DataFrame({"i": range(12), "x": [None, 1.0, None, None, None, None, None, 2.0, None, None, None, None]})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("b", F.floor(F.col("i") / 3))
    got = _sorted(panel.running(df, [], ["i"], "b", y=("last", "x")), "i")
    assert got.y.isna().tolist() == [True] + [False] * 11
    assert got.y.tolist()[1:] == [1.0] * 6 + [2.0] * 5


def test_compounded_curve_and_peak(spark):
    g = np.random.default_rng(2).normal(1.0, 0.02, 300)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(300), "g": g})).withColumn("b", F.floor(F.col("i") / 41))
    got = _sorted(panel.compounded(df, ["k"], ["i"], "b", "g"), "i")
    curve = np.cumprod(g)
    assert np.allclose(got.curve, curve) and np.allclose(got.peak, np.maximum.accumulate(curve))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 501), "v": rng.exponential(0.01, 501)})
    got = panel.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", [1 / 3, 2 / 3, 1.0], F.floor(F.col("v") * 1000))
    for r in got.collect():
        v = pdf[pdf.k == r["k"]].v
        assert np.allclose([r["q0"], r["q1"], r["q2"]], np.quantile(v, [1 / 3, 2 / 3, 1.0]))


def test_indicators_do_not_depend_on_segments(make_bars):
    bars = make_bars(walk("A", 1500), walk("B", 900, seed=11))
    whole = _sorted(features.compute_all(bars, rows=4096), "ticker", "date")
    cut = _sorted(features.compute_all(bars, rows=520), "ticker", "date")
    for name in whole.columns:
        if name in ("seg", "_first"):
            continue
        a, b = whole[name], cut[name]
        if a.dtype.kind == "f":
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), name
        else:
            assert (a == b).all(), name


def test_pivots_do_not_depend_on_segments(make_bars):
    bars = make_bars(walk("A", 400))
    a = _sorted(levels.pivots(bars), "date")
    b = _sorted(levels.pivots(bars, rows=23), "date")
    assert a.pivot_high.tolist() == b.pivot_high.tolist() and a.pivot_low.tolist() == b.pivot_low.tolist()


def _greedy(rows):
    busy, taken = {}, []
    for r in sorted(rows, key=lambda r: (r["date"], r["ticker"])):
        if busy.get(r["ticker"], -1) >= r["pos_t"]:
            continue
        busy[r["ticker"]] = r["pos_t"] + r["held"]
        taken.append((r["ticker"], r["pos_t"]))
    return sorted(taken)


@pytest.mark.parametrize("rows", [25, 40, 2048])
def test_one_position_equals_the_plain_loop(spark, rows):
    rng = np.random.default_rng(rows)
    pos = np.flatnonzero(rng.random(600) < 0.4) + 1
    frames = []
    for t in ("A", "B"):
        frames.append(pd.DataFrame({"s": "x", "ticker": t, "pos_t": pos, "held": rng.integers(1, 21, len(pos))}))
    pdf = pd.concat(frames).assign(date=lambda d: pd.Timestamp("2020-01-01") + pd.to_timedelta(d.pos_t, "D"))
    got = expectancy.one_position(spark.createDataFrame(pdf).withColumn("held", F.col("held").cast("int")), ["s"], rows=rows)
    assert sorted((r.ticker, r.pos_t) for r in got.collect()) == _greedy(pdf.to_dict("records"))


def _limited(rows, k):
    busy, opened, taken = {}, [], []
    for r in sorted(rows, key=lambda r: (r["date"], r["ticker"])):
        entry = r["date"] + pd.Timedelta(days=1)
        if busy.get(r["ticker"], -1) >= r["pos_t"] or sum(a <= entry <= b for a, b in opened) >= k:
            continue
        busy[r["ticker"]] = r["pos_t"] + r["held"]
        opened.append((entry, entry + pd.Timedelta(days=max(1, int(r["held"] * 1.45)))))
        taken.append((r["ticker"], r["pos_t"]))
    return sorted(taken)


@pytest.mark.parametrize("width", [1, 16])
def test_max_concurrent_is_exact_for_any_width(spark, width):
    rng = np.random.default_rng(4)
    rows = []
    for t in "ABCDEFGH":
        for p in np.flatnonzero(rng.random(120) < 0.6) + 1:
            day = pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(p))
            rows.append({"s": "x", "ticker": t, "pos_t": int(p), "held": int(rng.integers(1, 15)), "date": day})
    df = spark.createDataFrame(pd.DataFrame(rows)).withColumn("held", F.col("held").cast("int")).withColumn("date", F.to_date("date"))
    got = expectancy.max_concurrent(df, ["s"], limit=3, width=width)
    assert sorted((r.ticker, r.pos_t) for r in got.collect()) == _limited(rows, 3)


def test_an_own_slow_indicator_needs_no_word(make_bars):
    def slow():
        yield {"slow": features.ema(F.col("close"), 101)}

    bars = make_bars(walk("A", 4000))
    got = _sorted(features.compute(bars, [slow], rows=1000), "date")
    want = got.close.ewm(alpha=2 / 102, adjust=False).mean()
    assert np.allclose(got.slow, want, rtol=1e-12)
    assert features.decay_factors([slow, features.atr]) == {2 / 102, 1 / 14}
