import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import registry
from llm.exact_dedup import mark_duplicates
from llm_fixtures import words  # noqa: F401
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    """Documents with toxic ones, copies and near copies, nulls, repeated rows and an extra column."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if i % 6 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["zounds", "poltroon", "knave"]))
        docs.append((i, " ".join(text), ["en", "de"][i % 2], f"s{i % 3}", 1, "x"))
        labels.append((i, 1, int(i % 6 == 0)))
    near = docs[1][1].split()
    near[5] = "other"
    shout = docs[1][1].translate({k: k - 32 for k in range(97, 123)})
    docs += [(1000, shout, "en", "s1", 1, "x"), (1001, " ".join([*near, *near]), "en", "s1", 1, "x"), (1002, " ".join([*near, *near, "end"]), "en", "s1", 1, "x")]
    docs += [(None, None, None, None, None, None), (1003, "", "en", None, 0, "y"), (7, docs[7][1], "de", "s1", 1, "x")]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_decide(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            assert out.exceptAll(before).count() == 0
        kept[name] = out
        before = out
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in kept.items()}
    assert not {i for i in range(0, 600, 6)} & set(ids["toxicity"]) and len(set(range(600)) & set(ids["toxicity"])) >= 490
    assert 1 not in ids["exact_dedup"] and 1000 in ids["exact_dedup"] and ids["exact_dedup"].count(7) == 1
    assert mark_duplicates(kept["exact_dedup"]).where("group_size > 1").count() == 0
    groups = brute([(r.doc_id, r.text) for r in kept["exact_dedup"].collect()], 5, 80)
    assert sorted(ids["ngram_join"]) == sorted({c for _, c in groups.values()}) and 1002 not in ids["ngram_join"]
    packed = kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("c"))
    assert packed.agg(F.max("n")).first()[0] <= 2048 and set(ids["packing"]) == set(ids["mixing"])


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names
    assert set(registry.SQL) <= set(entry.oracle_sql())


def test_exact_dedup_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = registry.load_all()["op2_exact_dedup"](spark, SF)
    want = con.sql(registry.SQL["op2_exact_dedup"])
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
