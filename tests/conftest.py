import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small(spark):
    from barweave.sources.fixtures import Inputs

    return Inputs(spark, SF)


def walk(ticker="AAA", n=700, seed=7, start="2018-01-01", sigma=0.015):
    """Random-walk bars of one ticker as a pandas frame."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, sigma, n)))
    open_ = close * (1 + rng.normal(0, 0.004, n))
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.005, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.005, n)))
    dates = pd.bdate_range(start, periods=n).date
    return pd.DataFrame(
        {
            "ticker": ticker, "date": dates, "open": open_, "high": high, "low": low, "close": close,
            "volume": rng.integers(1_000, 9_000, n).astype(float), "prob_up": np.round(rng.uniform(0.3, 0.7, n), 3),
        }
    )


@pytest.fixture(scope="session")
def make_bars(spark):
    """pandas bars -> sequenced Spark bars."""
    from barweave.sources.bars import prepare

    def build(*frames):
        import pandas as pd

        df = spark.createDataFrame(pd.concat(frames, ignore_index=True))
        return prepare(df)

    return build
