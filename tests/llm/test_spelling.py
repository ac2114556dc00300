"""Spelling variants against plain edit distances."""

import random
import re
import zlib
from collections import Counter

import pytest

from llm import spelling
from llm.queries import op11

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_counts(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = [best if best and counts[best] >= 10 * n else None, n, len(near)]
    rows = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, counts[form] if form else None))
    return rows


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    parts = ["an", "na", "Er", "re", "tio", "ß", "éa", "on", "no", "×"]
    known = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 6))) for _ in range(40)]
    weights = [3 ** rng.randint(0, 5) for _ in known]
    rows = [(k, None if k == 0 else " ".join(rng.choices(known, weights, k=rng.randint(0, 300)))) for k in range(60)]
    typos = []
    for w in known * 4:
        k = rng.randrange(len(w))
        typos.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :]]))
    rows += [(100, " ".join(typos)), (101, " ".join(typos[::2])), (None, known[0]), (None, known[0]), (102, "a" * 5000 + " " + "a" * 5000), (103, "a" * 5001 + "1" + "a" * 5001), (104, "")]
    rows += [(200, "chained " * 5), (201, "chainedx " * 60), (202, "chainedxy " * 700)]  # each the form of the one before
    return rows + [rows[5]]


def test_words_and_variants(spark, docs, tmp_path):
    spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, word string, n int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    counts = plain_counts(docs)
    assert {tuple(r) for r in op11(spark, str(tmp_path)).collect()} == plain_variants(counts)
    assert any(v[1] != v[2] and v[1] for v in plain_variants(counts)), "no chain of forms"
    assert counts["chained"] == 5


@pytest.mark.parametrize("parts", [3, 8])
def test_all_near_words_of_a_dense_vocabulary(spark, parts, monkeypatch):
    """Anagrams by the dozen: classes with many words, more than a chunk."""
    monkeypatch.setattr(spelling, "CHUNK", 5)
    rng = random.Random(8)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(7, 8))) for _ in range(700)})
    words = spelling.cut(spark.createDataFrame([(w, rng.randint(2, 900)) for w in vocabulary], "word string, n bigint"), "w")
    got = [(r.word, r.near) for r in spelling.near(words, parts).collect()]
    want = {(a, b) for a in vocabulary for b in vocabulary if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_roots_of_a_long_chain(spark):
    words = spark.createDataFrame([(f"w{k}", f"w{k + 1}" if k < 40 else None) for k in range(41)], "word string, form string")
    assert {r.root for r in spelling.roots(words).collect()} == {"w40"}


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.counted(empty)).count() == 0
    alone = spark.createDataFrame([("lonesome", 5)], "word string, n bigint")
    assert [tuple(r) for r in spelling.variants(alone).collect()] == [("lonesome", 5, 0, None, None, "lonesome")]


def test_undamaged_counts(spark):
    df = spark.createDataFrame([(1, "Spelling spelling spElling short")], "doc_id bigint, text string")
    assert [tuple(r) for r in spelling.counted(df, damage=None).collect()] == [("spelling", 3)]


def test_no_table_that_grows_is_broadcast(spark):
    """Not even those that Spark takes for small: signatures are exploded from a small file."""
    joins = re.compile("(?:Broadcast|SortMerge|ShuffledHash)\\w*Join")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        words = spelling.cut(spark.createDataFrame([("lantern", 9), ("lanterns", 90), ("lanternss", 900)], "word string, n bigint"), "words")
        for found, n in ((spelling.near(words), 3), (spelling.variants(words, times=10), 1)):
            assert len(found.collect()) in (3, 4)
            for plan in (found._jdf.queryExecution().sparkPlan(), found._jdf.queryExecution().executedPlan()):
                assert set(joins.findall(plan.toString())) == {"SortMergeJoin"}
            assert len(joins.findall(found._jdf.queryExecution().sparkPlan().toString())) == n
        assert {r.word: r.root for r in found.collect()} == {"lantern": "lanternss", "lanterns": "lanternss", "lanternss": "lanternss"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
