"""Probability calibration on out-of-fold scores.

Rows with the same probability are merged into one weighted row first. Both
fits give the same result on the merged rows, and the fitted data shrinks to
the distinct probabilities.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.exprs import clip
from barweave.session import scratch_path

c = F.col

METHODS = ("isotonic", "platt")
LOW, HIGH = 0.01, 0.99
EPS = 1e-6


def merged(oof: DataFrame) -> DataFrame:
    """Mean target and row count per distinct probability."""
    return oof.groupBy("prob_up").agg(F.avg(c("target").cast("double")).alias("rate"), F.count(F.lit(1)).cast("double").alias("weight"))


#: Distinct probabilities that one task pools.
POOL_ROWS = 200_000
#: Blocks that may reach the driver; the fit ends with an error beyond it.
MOST_BLOCKS = 2_000_000


def pooled(rows: DataFrame, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Blocks (low, high, rate, weight) of ``merged`` rows, pooled within ranges of probability.

    Adjacent violators may be pooled in any grouping: what a range pools is constant in the whole
    fit as well. So each range of probabilities, in order, becomes its blocks, and ranges of
    blocks are pooled again, wider each time, until a round pools hardly anything any more.
    """

    def run(batches):
        import pyarrow as pa

        low, high, total, weight = [], [], [], []
        for batch in batches:
            for a, b, r, w in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                low.append(a)
                high.append(b)
                total.append(r * w)
                weight.append(w)
                while len(low) > 1 and total[-2] * weight[-1] >= total[-1] * weight[-2]:
                    b, s, w = high.pop(), total.pop(), weight.pop()
                    low.pop()
                    high[-1], total[-1], weight[-1] = b, total[-1] + s, weight[-1] + w
        names = ["low", "high", "rate", "weight"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in (low, high, [s / w for s, w in zip(total, weight, strict=True)], weight)], names=names)

    spark = rows.sparkSession
    blocks = rows.select(c("prob_up").alias("low"), c("prob_up").alias("high"), "rate", "weight")
    path = scratch_path(spark, "merged")
    blocks.write.parquet(path)
    blocks = spark.read.parquet(path)
    count = blocks.count()
    while True:
        ranges = max(1, -(-count // pool_rows))
        path = scratch_path(spark, "pooled")
        blocks.repartitionByRange(ranges, "low").sortWithinPartitions("low").mapInArrow(run, "low double, high double, rate double, weight double").write.parquet(path)
        blocks, before = spark.read.parquet(path), count
        count = blocks.count()
        if ranges == 1 or count > 0.9 * before:
            return blocks


def logit(p: Column) -> Column:
    p = clip(p, EPS, 1 - EPS)
    return F.log(p / (1 - p))


class Calibrator:
    """Isotonic or logistic map from raw to calibrated probability."""

    def __init__(self, method: str = "isotonic"):
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        self.method = method
        self.model = None

    def fit(self, oof: DataFrame) -> Calibrator:
        span = oof.agg(F.min("target").alias("lo"), F.max("target").alias("hi")).first()
        if span["lo"] == span["hi"]:
            raise ValueError("both classes are needed to calibrate")
        if self.method == "isotonic":
            # a block is constant in the fit: its two ends stand for it, and the driver sees blocks only
            blocks = pooled(merged(oof))
            if blocks.count() > MOST_BLOCKS:
                raise ValueError(f"the probabilities form more than {MOST_BLOCKS} steps; round them first")
            ends = blocks.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("prob_up"), "rate", F.when(c("low") == c("high"), c("weight")).otherwise(c("weight") / 2).alias("weight"))
            iso = IsotonicRegression(featuresCol="prob_up", labelCol="rate", weightCol="weight", predictionCol="_cal")
            self.model = iso.fit(ends)
        else:
            rows = merged(oof).withColumn("_z", logit(c("prob_up")))
            fit = GeneralizedLinearRegression(
                family="binomial", link="logit", featuresCol="_v", labelCol="rate", weightCol="weight", predictionCol="_cal", maxIter=100, tol=1e-12
            )
            self.model = fit.fit(_vector(rows))
        return self

    def transform(self, df: DataFrame, output: str = "prob_cal") -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the calibrator first")
        if self.method == "isotonic":
            return self.model.transform(df).withColumn(output, clip(c("_cal"), LOW, HIGH)).drop("_cal")
        scored = self.model.transform(_vector(df.withColumn("_z", logit(c("prob_up")))))
        return scored.withColumnRenamed("_cal", output).drop("_v", "_z")

    def knots(self) -> DataFrame:
        """The isotonic steps as a small table (one row per step boundary)."""
        if self.method != "isotonic" or self.model is None:
            raise RuntimeError("only a fitted isotonic map has knots")
        from pyspark.sql import SparkSession

        pairs = zip(self.model.boundaries.toArray().tolist(), self.model.predictions.toArray().tolist())
        return SparkSession.getActiveSession().createDataFrame(list(pairs), "prob_up double, prob_cal double")


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["_z"], outputCol="_v").transform(df)
