import random

from pyspark.sql import functions as F

from llm import toxicity
from llm_fixtures import words  # noqa: F401

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(spark, words, n, toxic):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        if toxic(i):
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zounds", "poltroon"]))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic(i))))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS)


def caught(model, docs, labels):
    rows = model.score(docs).join(labels, "doc_id").collect()
    bad, good = ([r.score >= 0.7 for r in rows if r.toxic == k] for k in (1, 0))
    return sum(bad) / len(bad), sum(good) / len(good)


def test_few_toxic_labels_are_learnt(spark, words):
    docs, labels = corpus(spark, words, 200, lambda i: i % 28 == 0)  # 8, of which 5 are learnt from
    model = toxicity.fit(docs, labels, use=F.col("doc_id") % 3 != 1)
    right, wrong = caught(model, docs, labels)
    assert model.constant is None and right > 0.7 and wrong < 0.05


def test_a_single_toxic_label_is_fitted(spark, words):
    docs, labels = corpus(spark, words, 60, lambda i: i == 8)
    for seed in (7, 8, 9, 10):
        model = toxicity.fit(docs, labels, use=F.lit(True), seed=seed)
        assert model.constant is None and all(0 <= r.score <= 1 for r in model.score(docs).collect())


def test_rare_toxic_rows_are_sampled_by_kind(spark, words):
    docs, labels = corpus(spark, words, 6000, lambda i: i % 100 == 0)
    model = toxicity.fit(docs, labels, use=F.lit(True), most_rows=200)  # 2 toxic rows in a uniform sample
    right, wrong = caught(model, docs, labels)
    assert model.constant is None and right > 0.9 and wrong < 0.02
