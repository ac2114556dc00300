import numpy as np
import pandas as pd
import pytest

from barweave.operators import scoring as sc
from barweave.operators.calibration import Calibrator


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(42)
    p = np.round(rng.uniform(0.2, 0.8, 2000), 3)
    y = (rng.random(2000) < 0.3 + 0.4 * p).astype(int)
    return spark.createDataFrame(pd.DataFrame({"prob_up": p, "target": y}))


@pytest.mark.parametrize("method", ["isotonic", "platt"])
def test_calibrated_values_are_bounded_and_monotone(pairs, method):
    out = Calibrator(method).fit(pairs).transform(pairs).toPandas().sort_values("prob_up")
    assert out.prob_cal.between(0.0, 1.0).all() and (out.prob_cal.diff().dropna() >= -1e-12).all()
    after = ((out.prob_cal - out.target) ** 2).mean()
    assert after <= ((out.prob_up - out.target) ** 2).mean()


def test_platt_matches_newton(pairs):
    out = Calibrator("platt").fit(pairs).transform(pairs).toPandas()
    z, y = np.log(out.prob_up / (1 - out.prob_up)).to_numpy(), out.target.to_numpy()
    x = np.column_stack([np.ones_like(z), z])
    w = np.zeros(2)
    for _ in range(20):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    assert np.allclose(out.prob_cal, 1 / (1 + np.exp(-x @ w)), atol=1e-8)


def test_errors(spark, pairs):
    with pytest.raises(ValueError):
        Calibrator("linear")
    with pytest.raises(RuntimeError):
        Calibrator().transform(pairs)
    with pytest.raises(ValueError):
        Calibrator().fit(pairs.where("target = 1"))


def test_knots_describe_the_isotonic_map(pairs):
    knots = Calibrator("isotonic").fit(pairs).knots().toPandas()
    assert (knots.prob_cal.diff().dropna() >= 0).all() and len(knots) < 500


def test_threshold_choice(spark):
    rows = [(0.5, 100, 0.5), (0.6, 40, 0.7), (0.7, 5, 0.9), (0.8, 0, None)]
    table = spark.createDataFrame(rows, "threshold double, signals long, precision double")
    assert sc.select_threshold(table).first()[0] == 0.6
    assert sc.select_threshold(table, min_signals=1000).first()[0] == 0.7
    assert sc.select_threshold(table.where("precision is null")).first()[0] == 0.5


def test_binary_metrics_are_zero_when_undefined(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "prediction int, target int")
    m = sc.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"], m["baseline"]) == (0.0, 0.0, 0.0, 0.5, 0.5)
