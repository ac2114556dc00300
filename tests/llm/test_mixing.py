import itertools
import math

import pytest
from pyspark.sql import functions as F

from llm import mixing
from llm_fixtures import no_docs, odd_docs, odd_texts, words  # noqa: F401


def rake(cells, goals, rounds=300):
    w = {k: n / sum(cells.values()) for k, n in cells.items()}
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            have = {}
            for k, x in w.items():
                have[k[axis]] = have.get(k[axis], 0) + x
            w = {k: x * goal[k[axis]] / have[k[axis]] for k, x in w.items()}
    return w


def test_factors_equal_plain_raking(spark):
    values = [("a", "b", "c"), ("en", "de"), ("t", "u")]
    cells = {k: 5 + 13 * i % 40 for i, k in enumerate(itertools.product(*values))}
    total = sum(cells.values())
    goals = []
    for axis in range(3):
        m = {}
        for k, n in cells.items():
            m[k[axis]] = m.get(k[axis], 0) + n
        s = sum(x**0.7 for x in m.values())
        goals.append({k: x**0.7 / s for k, x in m.items()})
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, n bigint")
    want = rake(cells, goals)
    for r in mixing.raked(df, "source", ["lang", "topic"]).collect():
        k = (r.source, r.lang, r.topic)
        assert r.factor * cells[k] / total == pytest.approx(want[k], rel=1e-4)


def test_given_targets_are_met(spark, odd_docs):
    docs = odd_docs.where("lang is not null and source is not null")
    goal = {"en": 0.8, "de": 0.2}
    rows = mixing.sampled(docs, {"source": F.col("source"), "lang": F.col("lang")}, targets={"lang": goal}).collect()
    weight = {k: sum(r.tokens * r.probability for r in rows if r.lang == k) for k in goal}
    assert weight["en"] / sum(weight.values()) == pytest.approx(0.8, abs=1e-3) and max(r.probability for r in rows) == pytest.approx(1.0)
    none = mixing.sampled(docs, {"source": F.col("source"), "lang": F.col("lang")}, targets={"lang": {"en": 1.0}}).collect()
    assert all(r.probability == 0 and not r.selected for r in none if r.lang == "de")


def test_draws(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    run = lambda: {r.row.doc_id: (r.probability, r.selected) for r in mixing.sampled(df, {"source": F.col("source"), "kind": F.lit("k")}, temper=0.0).collect()}
    rows = run()
    share = [s for p, s in rows.values() if p < 0.99]
    p = next(p for p, _ in rows.values() if p < 0.99)
    assert p == pytest.approx(1 / 3, rel=1e-6) and abs(sum(share) / len(share) - p) < 4 * math.sqrt(p * (1 - p) / len(share)) and rows == run()


def test_odd_rows(spark, odd_docs, no_docs):
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.coalesce("text", F.lit("")))}
    assert mixing.sampled(no_docs, columns).count() == 0
    df = odd_docs.union(odd_docs).withColumn("tokens", F.lit("mine")).withColumn("factor", F.lit(1))
    rows = mixing.sampled(df, columns).collect()
    fate = {}
    for r in rows:
        assert r.row.tokens == "mine" and 0 <= r.probability <= 1 and r.tokens >= 1
        fate.setdefault(r.row.doc_id, set()).add(r.selected)
    assert len(rows) == df.count() and all(len(f) == 1 for f in fate.values())
