import random

import pytest
from pyspark.sql import functions as F

from llm import toxicity
from llm_fixtures import no_docs, words  # noqa: F401

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, words):
    rng = random.Random(3)
    bad = ["zounds", "poltroon", "knave", "p0ltroon", "Knaves!"]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, use=F.col("doc_id") % 3 != 1)
    rows = model.score(docs).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    caught = [r.score >= 0.7 for r in rows if r.toxic == 1]
    wrong = [r.score >= 0.7 for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.95 and sum(wrong) / len(wrong) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_repeats_and_names(spark, corpus, no_docs):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (5, None, None)], LABELS)), use=F.lit(True))
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, " \n", 0.5), (4, "x", 0.1), (4, "x", 0.1), (5, "zounds " * 50_000, 0.0)], "doc_id bigint, text string, quality double")
    rows = {r.doc_id: r.score for r in model.score(odd).collect()}
    assert rows[1] == rows[2] and len(rows) == 5 and model.score(odd).count() == 6 and model.score(no_docs).count() == 0


def test_without_both_labels(spark, corpus):
    docs, labels = corpus
    clean = toxicity.fit(docs, labels.where("toxic = 0"), use=F.lit(True))
    none = toxicity.fit(docs, labels.where("false"), use=F.lit(True))
    assert {r.score for r in clean.score(docs).collect()} == {0.0} and {r.score for r in none.score(docs).collect()} == {0.0}


def test_features():
    flags = toxicity.Flags(frozenset(["idiot", "lowei*"]))
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! loweichen id1ot st.uff", flags), strict=True))
    assert f["hits"] == 3 and f["near"] == 3 and f["obfuscated_hits"] == 1 and f["exclamations"] > 0 and f["capital_words"] > 0
