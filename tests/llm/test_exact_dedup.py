import hashlib

from pyspark.sql import functions as F

from llm.exact_dedup import deduplicated, mark_duplicates
from llm_fixtures import no_docs, odd_docs, odd_texts, words  # noqa: F401


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def check(df, keep):
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    best = max if keep == "largest" else min
    got = mark_duplicates(df, keep=keep).collect()
    assert len(got) == len(rows)
    stays = {}
    for r in got:
        ids = groups[lower(r.row.text)]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (best(known) if known else None)
        assert r.group_size == len(ids)
        assert r.text_sha256 == hashlib.sha256(lower(r.row.text).encode()).hexdigest()
        if r.kept:
            assert r.row.doc_id == r.keep_id
            stays[lower(r.row.text)] = stays.get(lower(r.row.text), 0) + 1
    assert stays == dict.fromkeys(groups, 1)


def test_brute_force(odd_docs):
    for keep in ("largest", "smallest"):
        check(odd_docs, keep)


def test_ties_nulls_and_hot_groups(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None), (None, ""), (7, "B"), (5, "b"), (7, "b")] + [(100 + i, "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(df, "largest")
    got = mark_duplicates(df, keep="largest", hot_share=3)  # some groups take the way of the hot ones
    want = mark_duplicates(df, keep="largest")
    key = ["row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_empty_and_clashing_names(spark, no_docs):
    assert mark_duplicates(no_docs).count() == 0
    df = spark.createDataFrame([(1, "x", 5, "k"), (2, "X", 6, "m")], "doc_id bigint, text string, group_size int, kept string")
    df = df.withColumns({"_hash": F.lit(1), "row": F.lit(2), "_norm": F.lit(3)})
    out = deduplicated(df)
    assert out.columns == df.columns and [r.kept for r in out.collect()] == ["k"]


def test_native_plan(odd_docs):
    plan = mark_duplicates(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan
