import pytest
from pyspark.sql import functions as F

from llm import mixing
from llm.queries import MIXED_SHARE, mixed
from llm_fixtures import no_docs, odd_docs, odd_texts, words  # noqa: F401

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(rare):
    rows = [(i, "word " * (20 + i % 30), ["en", "de"][i % 2], f"s{i % 3 if i % 10 else 3}", 1) for i in range(3000)]
    return rows + ([(9999, "a b c d e", "en", "rare", 1)] if rare else [])


def kept(rows):
    return sum(r.tokens for r in rows if r.selected) / sum(r.tokens for r in rows)


def test_a_tiny_source_does_not_shrink_the_others(spark):
    without, beside = (mixed(spark.createDataFrame(corpus(rare), DOC)).collect() for rare in (False, True))
    for rows in (without, beside):
        assert kept(rows) == pytest.approx(MIXED_SHARE, abs=0.03)
        expected = sum(r.tokens * r.probability for r in rows)
        assert expected == pytest.approx(MIXED_SHARE * sum(r.tokens for r in rows), rel=1e-6)
    assert [r.probability for r in beside if r.source == "rare"] == [pytest.approx(1.0)]


def test_budget_is_solved_over_all_cells(spark):
    factors = spark.createDataFrame([(100, 0.1), (10, 3.0), (5, 20.0), (7, 0.0)], "n bigint, factor double")
    for tokens in (1.0, 12.0, 20.0, 80.0):
        a = mixing.scale_to(factors, tokens)
        assert sum(n * min(1.0, a * f) for n, f in ((100, 0.1), (10, 3.0), (5, 20.0))) == pytest.approx(tokens)
    assert mixing.scale_to(factors, 1000.0) * 0.1 >= 1
    assert mixing.scale_to(factors, 280.0, repeat=True) == pytest.approx(2.0)


def test_repeats_meet_the_targets(spark):
    df = spark.createDataFrame(corpus(True), DOC)
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    rows = mixing.sampled(df, columns, targets={"lang": {"en": 0.8, "de": 0.2}}, budget=0.9, repeat=True).collect()
    weight = {k: sum(r.tokens * r.copies for r in rows if r.lang == k) for k in ("en", "de")}
    total = sum(r.tokens for r in rows)
    assert sum(weight.values()) / total == pytest.approx(0.9, abs=0.02) and weight["en"] / sum(weight.values()) == pytest.approx(0.8, abs=0.02)
    assert max(r.copies for r in rows) > 1 and all(r.selected == (r.copies > 0) for r in rows)


def test_nothing(no_docs):
    assert mixed(no_docs).count() == 0
