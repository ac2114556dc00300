from types import SimpleNamespace
from unittest.mock import MagicMock

import pytest

from barweave.operators import features as f
from barweave.operators import models, splits
from barweave.plans import learning


class Stop(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """What a query asks its operator for, without training."""
    seen = {}

    def spy(owner, name):
        original = getattr(owner, name)

        def run(*args, **kwargs):
            import inspect

            call = inspect.signature(original).bind(*args, **kwargs)
            call.apply_defaults()
            seen.update(call.arguments)
            raise Stop

        monkeypatch.setattr(owner, name, run)

    monkeypatch.setattr(learning, "_training", lambda t: None)
    return SimpleNamespace(seen=seen, spy=spy)


def test_folds_use_all_features_and_the_default_members(spark, asked):
    asked.spy(models, "out_of_fold")
    with pytest.raises(Stop):
        learning.ml_oof(SimpleNamespace(store=lambda name, make: make()))
    assert asked.seen["features"] == f.MODEL_FEATURES and asked.seen["geometry"] == splits.Geometry() and asked.seen["geometry"].n_splits == 5
    members = asked.seen["make"]()
    assert members["boosted_a"].getMaxIter() == 200 and members["forest"].getNumTrees() == 200 and members["boosted_a"].getMaxDepth() == 6


def test_tuning_tries_as_much_as_the_reference(asked):
    asked.spy(models, "tune")
    with pytest.raises(Stop):
        learning.ml_tune(None)
    draws = asked.seen["draws"]
    assert len(draws) == 50 and all(100 <= d["maxIter"] <= 500 for d in draws) and asked.seen["trees"] is None
    assert asked.seen["features"] == f.MODEL_FEATURES and asked.seen["geometry"].n_splits == 5


@pytest.mark.parametrize("query", ["ml_final_fit", "sc_batch", "sc_panel"])
def test_ensembles_use_all_features(asked, monkeypatch, query):
    asked.spy(models, "Ensemble")
    monkeypatch.setattr(learning, "scratch_path", lambda *a: "")
    with pytest.raises(Stop):
        getattr(learning, query)(SimpleNamespace(spark=None))
    assert asked.seen["features"] == f.MODEL_FEATURES and asked.seen["estimators"] is None


def test_contributions_use_all_features(asked):
    asked.spy(models, "surrogate")
    with pytest.raises(Stop):
        learning.xp_contributions(None)
    assert asked.seen["features"] == f.MODEL_FEATURES


@pytest.mark.parametrize("query", ["ml_basic", "ml_importance"])
def test_the_small_model_has_its_hundred_trees(asked, monkeypatch, query):
    asked.spy(models, "basic_forest")
    monkeypatch.setattr(learning.targets, "split_temporal", lambda rows: MagicMock())
    monkeypatch.setattr(models, "training_rows", lambda rows, features: asked.seen.update(features=features))
    monkeypatch.setattr(learning, "c", MagicMock())
    with pytest.raises(Stop):
        getattr(learning, query)(None)
    assert asked.seen["trees"] == 100 and asked.seen["features"] == f.BASIC_FEATURES
