"""Training: soft-voting tree ensemble under purged walk-forward folds.

Members and folds are independent fits over one written table of assembled rows, from which a fold is
a range of dates. A table of at most ``trees.TASK_ROWS`` rows is binned and shuffled to the tasks, and all members of all folds are
grown side by side, a task each. A larger one is fitted by Spark's distributed trees, members and folds
submitted side by side, each in a scheduler pool of its own. Both learn from all rows with the members' settings.
Scoring is a distributed pass. What has been fitted is kept by ``Registry`` under its rows and settings.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators import splits, trees, trials
from barweave.operators.targets import class_weights
from barweave.session import checkpoint_dir, scratch_path

c = F.col

SEED = 42
#: Megabytes of statistics that a forest's task gathers at once: with more, fewer passes over the rows.
FOREST_MB = 512
#: Rows of a training table in one partition, at least: below it another task costs more than it saves.
PARTITION_ROWS = 50_000
#: Rows that a task scores by all members, at most.
SCORED_ROWS = 20_000
MEMBERS = ("boosted_a", "boosted_b", "forest", "extra_forest")


def member_estimators(trees: int = 200, depth: int = 6, seed: int = SEED, overrides: dict | None = None) -> dict:
    """Two boosted and two bagged classifiers.

    The second of each pair differs by seed, depth and column sampling.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "cacheNodeIds": True, "checkpointInterval": -1}
    boosted = {"maxIter": trees, "stepSize": 0.1, **common}
    forest = {"numTrees": trees, "maxMemoryInMB": FOREST_MB, **common}
    specs = {
        "boosted_a": (GBTClassifier, {**boosted, "maxDepth": depth, "seed": seed}),
        "boosted_b": (GBTClassifier, {**boosted, "maxDepth": max(2, depth - 1), "seed": seed + 1, "subsamplingRate": 0.8}),
        "forest": (RandomForestClassifier, {**forest, "maxDepth": min(depth + 4, 10), "seed": seed}),
        "extra_forest": (
            RandomForestClassifier,
            {**forest, "maxDepth": min(depth + 4, 10), "seed": seed + 1, "featureSubsetStrategy": "onethird", "subsamplingRate": 0.7},
        ),
    }
    return {name: cls(**{**params, **(overrides or {}).get(name, {})}) for name, (cls, params) in specs.items()}


def training_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Assembled rows with label and balanced class weight."""
    weights = class_weights(df).select(c("target"), "weight")
    rows = df.join(F.broadcast(weights), "target").withColumn("label", c("target").cast("double"))  # two rows
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def has_both_classes(df: DataFrame) -> bool:
    span = df.agg(F.min("target").alias("lo"), F.max("target").alias("hi")).first()
    return span["lo"] is not None and span["lo"] != span["hi"]


def in_parallel(spark, jobs: list[Callable], most: int | None = None) -> list:
    """Run independent jobs side by side, each in its own scheduler pool; their results in order.

    ``most`` bounds how many run at once (default: as many as the application has cores, 32 at most).
    """
    from concurrent.futures import ThreadPoolExecutor

    def pooled(k: int, job: Callable) -> Callable:
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k}")
            try:
                return job()
            finally:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

        return inheritable_thread_target(spark)(run)

    most = most or max(1, min(32, spark.sparkContext.defaultParallelism))
    with ThreadPoolExecutor(max_workers=most) as pool:
        return [f.result() for f in [pool.submit(pooled(k % most, job)) for k, job in enumerate(jobs)]]


def written_rows(df: DataFrame, name: str) -> DataFrame:
    """Write training rows once, sorted by date where they have one, in as few partitions as their number needs."""
    spark = df.sparkSession
    first = scratch_path(spark, f"{name}-rows")
    df.write.parquet(first)
    rows = spark.read.parquet(first)
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    path = scratch_path(spark, name)
    dealt = rows.repartitionByRange(parts, "date").sortWithinPartitions("date") if "date" in df.columns else rows.repartition(parts)
    dealt.write.parquet(path)
    return spark.read.parquet(path).coalesce(parts)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in tasks of about ``SCORED_ROWS``: scoring costs far more than reading, however few bytes the rows have."""
    return df.repartition(max(1, -(-df.count() // SCORED_ROWS)))


def fingerprint(df: DataFrame) -> str:
    """What tells one set of rows from another, in any order: their number and two sums of hashes."""
    row = F.xxhash64(*[c(x) for x in sorted(df.columns)])
    found = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum((row % 1_000_003).cast("long"))).first()
    return "-".join(map(str, (*sorted(df.columns), *found)))


def tree_spec(estimator) -> tuple | None:
    """(kind, params, seed) of an estimator that a task can grow; None for any other."""
    get = estimator.getOrDefault
    if isinstance(estimator, GBTClassifier):
        params = {"maxIter": get("maxIter"), "stepSize": get("stepSize")}
    elif isinstance(estimator, RandomForestClassifier):
        share = {"onethird": 1 / 3, "all": 1.0}.get(get("featureSubsetStrategy"), 1 / 7)  # about the root of 51
        params = {"numTrees": get("numTrees"), "levelShare": share}
    else:
        return None
    params |= {"maxDepth": get("maxDepth"), "subsamplingRate": get("subsamplingRate"), "minChildRows": get("minInstancesPerNode")}
    return "boosted" if isinstance(estimator, GBTClassifier) else "forest", params, int(get("seed") % (1 << 31))


def fit_members(spark, tables: dict, estimators: dict, n_rows: int) -> dict[tuple, object]:
    """The fitted members by (key, name). ``tables``: by key rows (features, label, weight); ``n_rows`` is the largest one's number."""
    asked = [(key, name, est) for key, members in estimators.items() for name, est in members.items()]
    specs = [tree_spec(est) for _, _, est in asked]
    if n_rows <= trees.TASK_ROWS and all(specs):
        return trees.fit(spark, tables, [(key, name, *spec) for (key, name, _), spec in zip(asked, specs, strict=True)])
    jobs = [lambda est=est, rows=tables[key]: est.fit(rows) for key, _, est in asked]
    return {(key, name): model for (key, name, _), model in zip(asked, in_parallel(spark, jobs), strict=True)}


class Registry:
    """Fitted ensembles by training rows and settings: in memory, and saved below the shared checkpoint folder.

    A second query, or another application with the same folder, loads what was fitted before.
    """

    _fitted: dict[tuple[str, str], Ensemble] = {}

    def __init__(self, spark):
        self.spark = spark

    def key(self, df: DataFrame, features: list[str], estimators: dict) -> str:
        params = {n: [type(e).__name__, {p.name: str(v) for p, v in sorted(e.extractParamMap().items(), key=lambda x: x[0].name)}] for n, e in estimators.items()}
        said = json.dumps([fingerprint(df.select(*features, "target")), features, params])
        return hashlib.sha256(said.encode()).hexdigest()[:24]

    def fit(self, df: DataFrame, features: list[str], estimators: dict | None = None) -> Ensemble:
        """The ensemble for these rows and settings, fitted now only if it never was."""
        model = Ensemble(features, estimators)
        key = self.key(df, features, model.estimators)
        known, path = (self.spark.sparkContext.applicationId, key), f"{checkpoint_dir(self.spark)}/models/{key}"
        if known not in self._fitted:
            try:
                self._fitted[known] = Ensemble.load(path)
            except AnalysisException:  # not there yet
                model.fit(df).save(path, {"key": key})
                self._fitted[known] = model
        return self._fitted[known]


class Ensemble:
    """Mean of the members' up-probabilities."""

    def __init__(self, features: list[str], estimators: dict | None = None):
        self.features = list(features)
        self.estimators = estimators or member_estimators()
        self.models: dict = {}

    def fit(self, df: DataFrame) -> Ensemble:
        # one durable table feeds every member, so no fit recomputes the features
        rows = written_rows(training_rows(df, self.features).select("features", "label", "weight"), "training")
        found = fit_members(df.sparkSession, {0: rows}, {0: self.estimators}, rows.count())
        self.models = {name: found[0, name] for name in self.estimators}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prob_<member>`` and ``prob_up``."""
        out = df.drop("prob_up")
        if "features" not in df.columns:
            out = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="skip").transform(out)
        grown = {n: m for n, m in self.models.items() if isinstance(m, trees.TreeModel)}
        if grown:
            values = out.withColumn("_x", vector_to_array("features"))
            out = values.withColumns({f"prob_{n}": m.probability(c("_x")) for n, m in grown.items()}).drop("_x")
        for name, model in self.models.items():
            if name in grown:
                continue
            out = model.transform(out).withColumn(f"prob_{name}", vector_to_array("probability")[1])
            out = out.drop("rawPrediction", "probability", "prediction")
        mean = sum((c(f"prob_{n}") for n in self.models), F.lit(0.0)) / len(self.models)
        return out.withColumn("prob_up", mean).drop("features")

    def save(self, path: str, metadata: dict) -> None:
        """Members as a table of trees or a pipeline each, and then one metadata row."""
        spark = _session()
        grown = [n for n, m in self.models.items() if isinstance(m, trees.TreeModel)]
        for name, model in self.models.items():
            if name in grown:
                model.save(spark, f"{path}/{name}-trees")
            else:
                PipelineModel(stages=[model]).write().overwrite().save(f"{path}/{name}")
        row = {**{k: str(v) for k, v in metadata.items()}, "features": self.features, "members": list(self.models), "grown": [*grown, ""]}
        spark.createDataFrame([row]).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> Ensemble:
        meta = _session().read.parquet(f"{path}/metadata").first()
        out = cls(list(meta["features"]))
        one = lambda n: trees.TreeModel.load(_session(), f"{path}/{n}-trees") if n in meta["grown"] else PipelineModel.load(f"{path}/{n}").stages[0]
        out.models = {n: one(n) for n in meta["members"]}
        return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def out_of_fold(df: DataFrame, features: list[str], make, geometry: splits.Geometry = splits.Geometry()) -> DataFrame:
    """(ticker, date, fold, target, prob_up, member probabilities) scored by models of the past only.

    ``make()`` returns fresh estimators. A fold whose training rows hold one
    class is skipped.
    """
    rows, spans, counts = _folded(df, features, geometry)
    tables, estimators = {}, {}
    for fold, n in counts.items():
        if min(n.values()) == 0:
            continue
        weight = F.when(c("target") == 1, sum(n.values()) / (2.0 * n[1])).otherwise(sum(n.values()) / (2.0 * n[0]))
        tables[fold] = _between(rows, spans[fold, "train"]).select("features", c("target").cast("double").alias("label"), weight.alias("weight"))
        estimators[fold] = make()
    most = max((sum(counts[f].values()) for f in tables), default=0)
    models, parts = fit_members(df.sparkSession, tables, estimators, most), []
    for fold in sorted(tables):
        model = Ensemble(features)
        model.models = {n: m for (f, n), m in models.items() if f == fold}
        scored = model.transform(_between(rows, spans[fold, "test"]).withColumn("fold", F.lit(fold)))
        parts.append(scored.select("ticker", "date", "fold", "target", "prob_up", *[f"prob_{m}" for m in model.models]))
    if not parts:
        raise RuntimeError("no fold could be evaluated")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _between(rows: DataFrame, span: tuple) -> DataFrame:
    return rows.where(c("date").between(*[F.lit(x) for x in span]))


def _folded(df: DataFrame, features: list[str], geometry: splits.Geometry) -> tuple[DataFrame, dict, dict]:
    """Assembled rows in one written table, the dates of each fold's sides, and its training rows by target.

    Both sides of a fold are unbroken ranges of dates, so a fold is read by pruning.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    rows = written_rows(assembler.transform(df).select("ticker", "date", "target", "features"), "folded")
    sides = splits.date_folds(df.select("date"), geometry).groupBy("fold", "role").agg(F.min("date"), F.max("date")).collect()
    spans = {(r[0], r[1]): (r[2], r[3]) for r in sides}
    trains = {f: s for (f, role), s in spans.items() if role == "train" and (f, "test") in spans}
    inside = {f"f{f}_{y}": F.count_if(c("date").between(*[F.lit(x) for x in s]) & (c("target") == y)) for f, s in trains.items() for y in (0, 1)}
    found = rows.agg(F.lit(1), *[x.alias(n) for n, x in inside.items()]).first()
    return rows, spans, {f: {y: found[f"f{f}_{y}"] for y in (0, 1)} for f in sorted(trains)}


def member_predictions(oof: DataFrame) -> DataFrame:
    """Long table (model, fold, prediction, target)."""
    names = [x.removeprefix("prob_") for x in oof.columns if x.startswith("prob_") and x != "prob_up"]
    items = F.array(*[F.struct(F.lit(n).alias("model"), (c(f"prob_{n}") >= 0.5).cast("int").alias("prediction")) for n in names])
    return oof.select("fold", "target", F.explode(items).alias("m")).select("fold", "target", "m.*")


def random_draws(n: int, seed: int = SEED, member: str = "boosted_a") -> list[dict]:
    """Random points of a boosted member's search space: seven dimensions each."""
    rng = random.Random(f"{seed}-{member}" if member != "boosted_a" else seed)
    own = {
        "boosted_a": lambda: {"maxDepth": rng.randint(3, 8), "minChildWeight": rng.randint(1, 7), "minGain": round(rng.uniform(0.0, 0.5), 3)},
        "boosted_b": lambda: {"maxDepth": rng.randint(3, 10), "maxLeaves": rng.randint(20, 150), "minChildRows": rng.randint(5, 100)},
    }[member]
    return [
        {
            **own(),
            "stepSize": round(10 ** rng.uniform(-2, -0.523), 4),
            "subsamplingRate": round(rng.uniform(0.6, 1.0), 2),
            "featureShare": round(rng.uniform(0.6, 1.0), 2),
            "maxIter": rng.randint(100, 500),
        }
        for _ in range(n)
    ]


def tune(df: DataFrame, features: list[str], draws: list[dict], trees: int | None = None, geometry: splits.Geometry = splits.Geometry(), rows: int = trials.ROWS) -> DataFrame:
    """Mean of the purged folds' accuracies of each draw; one row per draw, best first.

    A draw with a fold that cannot be evaluated counts 0.5. ``trees``, if given, is used instead of the draws' own.
    Each draw and fold is one trial, and each trial one task (``trials.accuracies``), learnt on at most ``rows`` rows of its
    fold; all rows of the fold's test side are scored.
    """
    draws = [{**d, "maxIter": trees} for d in draws] if trees else draws
    table, spans, counts = _folded(df, features, geometry)
    found = trials.accuracies(table, spans, [f for f, n in counts.items() if min(n.values())], draws, rows)
    spec = ", ".join(f"{k} double" for k in sorted(draws[0]))
    listed = df.sparkSession.createDataFrame([(i, *[float(d[k]) for k in sorted(d)]) for i, d in enumerate(draws)], f"draw int, {spec}")
    whole = F.when(c("_n") == geometry.n_splits, c("_acc")).otherwise(0.5)
    return listed.join(found.groupBy("draw").agg(F.avg("accuracy").alias("_acc"), F.count(F.lit(1)).alias("_n")), "draw", "left").select(
        *listed.columns, F.coalesce(whole, F.lit(0.5)).alias("accuracy")
    ).orderBy(c("accuracy").desc(), "draw")


def basic_forest(trees: int = 100, depth: int = 5) -> RandomForestClassifier:
    """The small model."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol="features", labelCol="label")


def importances(model, features: list[str], top: int | None = None) -> DataFrame:
    """Feature importances, largest first (one row per feature)."""
    pairs = list(zip(features, map(float, model.featureImportances.toArray())))
    df = _session().createDataFrame(pairs, "feature string, importance double").orderBy(c("importance").desc(), "feature")
    return df.limit(top) if top else df


def surrogate(df: DataFrame, features: list[str]) -> tuple[dict, dict, float]:
    """Coefficients, means and base of a logistic surrogate, on the original feature scale.

    The base is the log-odds of a row at the means; ``explain.pressure`` takes it.
    """
    rows = training_rows(df, features)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", regParam=0.01, maxIter=50)
    model = Pipeline(stages=[scaler, lr]).fit(rows)
    sd, mean, coef = model.stages[0].std.toArray(), model.stages[0].mean.toArray(), model.stages[1].coefficients.toArray()
    beta = [float(b / s) if s else 0.0 for b, s in zip(coef, sd)]
    return dict(zip(features, beta)), dict(zip(features, map(float, mean))), float(model.stages[1].intercept)


def scorable(panel_rows: DataFrame, features: list[str], min_rows: int = 60) -> DataFrame:
    """All complete rows of the tickers with enough of them."""
    rows = panel_rows.dropna(how="any", subset=features)
    enough = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= min_rows)
    return rows.join(enough.select("ticker"), "ticker", "left_semi")
