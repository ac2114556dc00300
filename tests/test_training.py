"""Fits that really run: small ensembles, folds, the registry, trials, and every learning query on the smallest data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import models, splits, trees


@pytest.fixture(scope="module")
def panel_rows(spark):
    rng = np.random.default_rng(3)
    dates = pd.bdate_range("2020-01-01", periods=400).date
    x = rng.normal(size=(2, 400, 3))
    up = (x[:, :, 0] + 0.5 * x[:, :, 1] + rng.normal(0, 0.5, (2, 400)) > 0).astype(int)
    frames = [pd.DataFrame({"ticker": t, "date": dates, "a": x[k, :, 0], "b": x[k, :, 1], "c": x[k, :, 2], "target": up[k]}) for k, t in enumerate("PQ")]
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


def small(seed=1):
    return models.member_estimators(trees=5, depth=3, seed=seed)


def test_folds_are_scored_by_models_of_the_past(panel_rows):
    oof = models.out_of_fold(panel_rows, ["a", "b", "c"], small)
    want = splits.panel_folds(panel_rows).where("role = 'test'").select("ticker", "date", "fold")
    assert oof.select("ticker", "date", "fold").exceptAll(want).isEmpty() and oof.count() == want.count()
    pdf = oof.toPandas()
    assert np.allclose(pdf[[f"prob_{m}" for m in models.MEMBERS]].mean(axis=1), pdf.prob_up) and pdf.prob_up.between(0, 1).all()
    assert ((pdf.prob_up >= 0.5) == (pdf.target == 1)).mean() > 0.7


def test_a_large_table_is_fitted_by_distributed_trees(panel_rows, monkeypatch):
    monkeypatch.setattr(trees, "TASK_ROWS", 10)
    few = lambda: models.member_estimators(trees=2, depth=2)
    oof = models.out_of_fold(panel_rows, ["a", "b"], few, splits.Geometry(n_splits=2)).toPandas()
    assert np.allclose(oof[[f"prob_{m}" for m in models.MEMBERS]].mean(axis=1), oof.prob_up) and len(oof)
    assert ((oof.prob_up >= 0.5) == (oof.target == 1)).mean() > 0.65


def test_rows_reach_the_tasks_and_not_the_driver(spark, panel_rows, monkeypatch):
    """Binned rows are shuffled to the task that grows a member; the models are those of the whole table in one array."""
    rows = models.written_rows(models.training_rows(panel_rows, ["a", "b", "c"]).select("features", "label", "weight"), "rows").repartition(3)
    rows = rows.localCheckpoint()
    x, target, weight = trees.matrix(rows, "label", "weight")
    monkeypatch.setattr(trees, "matrix", lambda *a: pytest.fail("the rows were collected"))
    estimators = {0: small(), 1: small(seed=2)}
    found = models.fit_members(spark, {0: rows, 1: rows.limit(500).localCheckpoint()}, estimators, rows.count())
    assert set(found) == {(key, m) for key in (0, 1) for m in models.MEMBERS}
    cuts = trees.cuts_of(x)
    for name, est in estimators[0].items():
        kind, params, seed = models.tree_spec(est)
        want = trees.KINDS[kind](trees.binned(x, cuts), target, params, weight, seed)
        for (f, cut, v), (g, b, w) in zip(found[0, name].trees, want, strict=True):
            assert (f == g).all() and np.array_equal(v, w) and np.array_equal(cut[f >= 0], cuts[g[f >= 0], b[f >= 0]])


def test_growing_a_tree_holds_a_feature_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(2)
    bins = rng.integers(0, 32, (20_000, 50)).astype(np.uint8)
    tracemalloc.start()
    found = trees.boosted(bins, (bins[:, 0] > 15).astype(float), {"maxIter": 2, "maxDepth": 4, "stepSize": 0.1})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][0][0] == 0 and peak < 10 * bins.nbytes  # a number of 8 bytes for each value alone is 8 times the bins


def test_rows_to_score_are_dealt_by_number(spark, panel_rows, monkeypatch):
    monkeypatch.setattr(models, "SCORED_ROWS", 100)
    dealt = models.spread(panel_rows.coalesce(1))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 110 and dealt.exceptAll(panel_rows).isEmpty() and sum(sizes) == 800


def test_a_forest_is_a_mean_of_leaf_means():
    rng = np.random.default_rng(1)
    bins, target = rng.integers(0, 32, (500, 3)).astype(np.uint8), rng.integers(0, 2, 500).astype(float)
    found = trees.forest(bins, target, {"numTrees": 7, "maxDepth": 4, "levelShare": 0.5})
    p = trees.leaves(bins, found)
    assert (p >= 0).all() and (p <= 1 + 1e-9).all() and np.corrcoef(p, target)[0, 1] > 0.3
    whole = trees.forest(bins, target, {"numTrees": 3, "maxDepth": 0, "levelShare": 1.0})
    assert abs(trees.leaves(bins, whole)[0] - target.mean()) < 0.1


def test_a_fold_with_one_class_is_skipped(panel_rows):
    late = panel_rows.withColumn("target", F.when(F.col("date") > "2020-05-01", F.col("target")).otherwise(1))
    folds = {r.fold for r in models.out_of_fold(late, ["a", "b"], small).select("fold").distinct().collect()}
    assert folds and 0 not in folds
    with pytest.raises(RuntimeError):
        models.out_of_fold(panel_rows.withColumn("target", F.lit(1)), ["a"], small)


def test_equal_rows_and_settings_are_fitted_once(spark, panel_rows, monkeypatch):
    registry, fits = models.Registry(spark), []
    fit = models.Ensemble.fit
    monkeypatch.setattr(models.Ensemble, "fit", lambda self, df: fits.append(1) or fit(self, df))
    one = registry.fit(panel_rows, ["a", "b"], small())
    assert registry.fit(panel_rows.repartition(3), ["a", "b"], small()) is one and len(fits) == 1
    registry.fit(panel_rows, ["a", "b"], small(seed=2))
    registry.fit(panel_rows.where("ticker = 'P'"), ["a", "b"], small())
    assert len(fits) == 3
    models.Registry._fitted.clear()  # another application: loaded from the folder
    again = registry.fit(panel_rows, ["a", "b"], small())
    assert len(fits) == 3
    p, q = (m.transform(panel_rows).orderBy("ticker", "date").toPandas().prob_up for m in (one, again))
    assert np.allclose(p, q)


def test_parallel_jobs_keep_their_order_and_raise(spark):
    assert models.in_parallel(spark, [lambda k=k: spark.range(k).count() for k in range(9)]) == list(range(9))
    with pytest.raises(ZeroDivisionError):
        models.in_parallel(spark, [lambda: 1, lambda: 1 // 0])


def test_one_tree_is_the_best_split_of_a_plain_loop():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 8, (300, 4)).astype(np.uint8)
    target = (bins[:, 2] > 4).astype(float)
    params = {"maxIter": 1, "maxDepth": 1, "stepSize": 1.0, "subsamplingRate": 1.0, "featureShare": 1.0}
    ((feature, cut, value),) = trees.boosted(bins, target, params)
    g, h = 0.5 - target, np.full(300, 0.25)

    def gain(f, b):
        left = bins[:, f] <= b
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))

    assert (feature[0], cut[0]) == max(((f, b) for f in range(4) for b in range(8)), key=lambda x: gain(*x)) == (2, 4)
    left = bins[:, 2] <= 4  # the gain of a plain loop
    assert value[1] == pytest.approx(-g[left].sum() / (h[left].sum() + 1)) and value[2] == pytest.approx(-g[~left].sum() / (h[~left].sum() + 1))


@pytest.mark.parametrize("member", ["boosted_a", "boosted_b"])
def test_trials_learn_and_keep_their_limits(member):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=(1500, 6)), rng.normal(size=(1500, 6))
    y, w = ((v[:, 0] * v[:, 1] > 0).astype(float) for v in (x, z))
    cuts = trees.cuts_of(x)
    a, b = trees.binned(x, cuts), trees.binned(z, cuts)
    params = {**models.random_draws(3, member=member)[0], "maxIter": 60, "stepSize": 0.3, "featureShare": 1.0, "maxDepth": 4}
    found = trees.boosted(a, y, params)
    assert ((trees.leaves(b, found) > 0) == (w > 0.5)).mean() > 0.85
    assert all((f >= 0).sum() + 1 <= params.get("maxLeaves", 16) for f, _, _ in found)
    few = trees.boosted(a, y, {**params, "maxLeaves": 5})
    assert all((f >= 0).sum() + 1 <= 5 for f, _, _ in few)


def test_tuning_ranks_the_draws(spark, panel_rows):
    good = {"maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0, "featureShare": 1.0, "maxIter": 40, "minChildWeight": 1, "minGain": 0.0}
    bad = {**good, "maxIter": 1, "minGain": 1e9}
    rows = models.tune(panel_rows, ["a", "b", "c"], [bad, good]).collect()
    assert [r.draw for r in rows] == [1, 0] and rows[0].accuracy > 0.75
    one = models.tune(panel_rows.withColumn("target", F.lit(1)), ["a"], [good]).first()
    assert one.accuracy == 0.5


LEARNT = ["ml_ensemble", "ml_oof", "ml_oof_member_scores", "ml_tune", "ml_final_fit", "ml_basic", "ml_importance", "sc_batch", "sc_panel", "ss_scan_cycle", "xp_contributions"]


@pytest.mark.parametrize("name", LEARNT)
def test_learning_queries_run(spark, small_learning, name):
    import duckdb

    from barweave.plans.registry import load_all
    from conftest import SF

    q = load_all()[name]
    df = q(spark, SF)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert rows or name.startswith(("sc_", "ss_", "xp_"))
    if q.sql is not None:
        con = duckdb.connect()
        for t in ("lineitem", "part", "orders"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.sql(q.sql)
        assert sorted(found.columns) == sorted(df.columns)
        assert sorted(rows, key=str) == sorted(found.select(*sorted(df.columns)).fetchall(), key=str)


@pytest.fixture
def small_learning(monkeypatch):
    """The queries as they are, with few trees and draws."""
    from barweave.plans import learning

    estimators = models.member_estimators
    monkeypatch.setattr(models, "member_estimators", lambda: estimators(trees=3, depth=3))
    monkeypatch.setattr(models, "basic_forest", lambda forest=models.basic_forest: forest(trees=5))
    boosted = trees.boosted
    monkeypatch.setattr(trees, "boosted", lambda bins, target, params: boosted(bins, target, {**params, "maxIter": 3}))
    assert learning._TRIALS == 50
