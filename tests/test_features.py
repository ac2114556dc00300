import numpy as np
import pandas as pd
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barweave import panel
from barweave.operators import features as f
from barweave.operators import targets


@pytest.fixture(scope="module")
def computed(make_bars):
    pdf = walk("AAA", 400)
    out = f.compute(make_bars(pdf), [f.emas, f.macd, f.atr, f.adx, f.rsi, f.volatility, f.cci]).toPandas()
    return pdf, out.sort_values("date").reset_index(drop=True)


def test_ema_and_macd_match_pandas(computed):
    pdf, out = computed
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    assert np.allclose(out.ema_12, ema(pdf.close, 12)) and np.allclose(out.ema_26, ema(pdf.close, 26))
    line = (ema(pdf.close, 12) - ema(pdf.close, 26)).where(np.arange(400) >= 25)
    signal = ema(line.dropna(), 9)
    assert np.allclose(out.macd, line, equal_nan=True)
    assert np.allclose(out.macd_signal[33:], signal[8:]) and out.macd_signal[:33].isna().all()


def _wilder(x, n, start):
    out = np.full(len(x), np.nan)
    out[start] = np.mean(x[start - n + 1 : start + 1])
    for i in range(start + 1, len(x)):
        out[i] = ((n - 1) * out[i - 1] + x[i]) / n
    return out


def test_atr_and_adx_match_a_plain_loop(computed):
    pdf, out = computed
    h, low, prev = pdf.high, pdf.low, pdf.close.shift()
    tr = pd.concat([h - low, (h - prev).abs(), (low - prev).abs()], axis=1).max(axis=1).to_numpy()
    assert np.allclose(out.atr, _wilder(tr, 14, 13), equal_nan=True)
    up, down = h.diff().to_numpy(), -low.diff().to_numpy()
    pdm = np.where((up > down) & (up > 0), up, 0.0)
    mdm = np.where((down > up) & (down > 0), down, 0.0)
    s = [_wilder(x, 14, 14) for x in (tr, pdm, mdm)]
    p, m = s[1] / s[0], s[2] / s[0]
    dx = 100 * np.abs(p - m) / (p + m)
    assert np.allclose(out.adx, _wilder(dx, 14, 27), equal_nan=True)


def test_rsi_and_rolling_std(computed):
    pdf, out = computed
    d = pdf.close.diff()
    gain = d.clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-d).clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False).mean()
    rsi = (100 - 100 / (1 + gain / loss)).where(np.arange(400) >= 13)
    assert np.allclose(out.rsi, rsi, equal_nan=True)
    assert np.allclose(out.vol_20d, pdf.close.pct_change().rolling(20).std(), equal_nan=True)


def test_normalised_columns_ignore_the_price_level(make_bars, computed):
    pdf, base = computed
    doubled = pdf.assign(**{k: pdf[k] * 2 for k in ("open", "high", "low", "close")})
    out = f.compute(make_bars(doubled), [f.macd, f.atr]).toPandas().sort_values("date").reset_index(drop=True)
    assert np.allclose(out.macd_norm, base.macd_norm, equal_nan=True)
    assert np.allclose(out.atr_pct, base.atr_pct, equal_nan=True)


def test_flat_candles_give_null_not_nan(make_bars):
    flat = walk("F", 40).assign(open=10.0, high=10.0, low=10.0, close=10.0)
    rows = f.compute(make_bars(flat), [f.candle, f.stochastic, f.bollinger]).collect()
    assert all(r["body_pct"] is None and r["stoch_k"] is None and r["bb_pct"] is None for r in rows)


def test_target_stays_inside_a_ticker_and_last_is_zero(make_bars):
    low, high = walk("A", 30), walk("B", 30, seed=2)
    high[["open", "high", "low", "close"]] *= 50
    bars = make_bars(low, high)
    out = panel.windowed(bars, [targets.add_direction()], ahead=1).toPandas().sort_values(["ticker", "date"])
    for t, pdf in (("A", low), ("B", high)):
        want = (pdf.close.shift(-1) > pdf.close).astype(int)
        assert out[out.ticker == t].target.tolist() == want.tolist()
    assert out.groupby("ticker").target.last().tolist() == [0, 0]
    nulled = panel.windowed(bars, [targets.add_direction(keep_last=False)], ahead=1).where("target is null")
    assert nulled.count() == 2


def test_one_shuffle_serves_all_windows(small):
    plan = f.compute(small.bars, f.ALL[:-1]).drop("obv")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    one = f.compute(small.bars, [f.returns, f.volatility, f.sma, f.macd, f.adx])._jdf.queryExecution().executedPlan().toString()
    assert one.count("Exchange hashpartitioning(ticker") == 1


def test_slow_averages_need_their_warm_up_and_long_segments_are_refused(make_bars):
    from barweave.functions.recurrence import ema, span_alpha, warmup_rows

    frame = walk(n=6000)
    bars = make_bars(frame)

    def slow():
        yield {"slow": ema(F.col("close"), 60)}

    with pytest.raises(ValueError):
        f.compute(bars, [slow], rows=4096)
    assert warmup_rows(1 / 14) <= 512
    alpha = span_alpha(60)
    got = f.compute(bars, [slow], rows=2048, slowest=alpha, steepest=alpha).select("seq", "slow").orderBy("seq").toPandas()
    want = frame["close"].ewm(span=60, adjust=False).mean()
    assert ((got["slow"] - pd.Series(want.values)) / want.values).abs().max() < 1e-12
