import pandas as pd
import pytest
from conftest import walk

from barweave.operators import splits


def test_panel_folds_go_forward_with_a_gap(make_bars):
    folds = splits.panel_folds(make_bars(walk("A", 900), walk("B", 900, seed=1))).toPandas()
    calendar = {d: i for i, d in enumerate(sorted(folds.date.unique()))}
    dates = {d: i for i, d in enumerate(sorted(pd.bdate_range("2018-01-01", periods=900).date))}
    sizes, last_end = [], None
    for k in range(5):
        part = folds[folds.fold == k]
        train, test = part[part.role == "train"], part[part.role == "test"]
        assert set(train.date).isdisjoint(test.date)
        assert dates[min(test.date)] - dates[max(train.date)] == 66  # 60 + 5 sessions lie between
        assert test.groupby("date").ticker.nunique().eq(2).all()
        sizes.append(test.date.nunique())
        if last_end is not None:
            assert dates[min(test.date)] == last_end + 1
        last_end = dates[max(test.date)]
    assert len(set(sizes)) == 1 and last_end == 899 and calendar


def test_serial_bounds(spark):
    n, g = 1500, splits.Geometry()
    rows = splits.bounds(spark.createDataFrame([("A", n)], "ticker string, n long"), g).orderBy("fold").collect()
    test = (n - n // 10 - 65) // 5
    assert [r["test_start"] for r in rows] == [n - (5 - i) * test for i in range(5)]
    assert all(r["train_end"] == r["test_start"] - 65 for r in rows) and rows[-1]["test_end"] == n


def test_bad_geometry_is_rejected(spark):
    with pytest.raises(ValueError):
        splits.Geometry(n_splits=1)
    with pytest.raises(ValueError):
        splits.Geometry(gap=-1)
    with pytest.raises(ValueError):
        splits.check(100, splits.Geometry())
    splits.check(1200, splits.Geometry())
    assert splits.bounds(spark.createDataFrame([("A", 100)], "ticker string, n long"), splits.Geometry()).count() == 0
