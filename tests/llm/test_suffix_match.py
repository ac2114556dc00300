"""Suffix-array matching against plain loops over windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import suffix_match
from llm.queries import op12

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain(text, items, window=10):
    """(n_words, hit places, {item: longest match}) by comparing every window with every place."""
    words, hit, found = split(text), set(), {}
    for item, other in items:
        other = split(other)
        n = min(window, len(other))
        for a in range(len(words) - n + 1 if n else 0):
            for b in range(len(other) - n + 1):
                if words[a : a + n] == other[b : b + n]:
                    hit.update(range(a, a + n))
                    m = n
                    while a + m < len(words) and b + m < len(other) and words[a + m] == other[b + m]:
                        m += 1
                    found[str("" if item is None else item)] = max(m, found.get(str("" if item is None else item), 0))
    return len(words), hit, found


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "Ab", "é", "日本", "x1", "0"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    items = [(k, say(rng.randint(1, 40))) for k in range(30)] + [(100, None), (101, " ,. "), (102, "one two"), (102, "three four five"), (None, say(12))]
    items += [(200 + k, items[k][1]) for k in range(5)]  # repeated texts
    docs = [None, "", "ONE  two", "one, TWO three", "three four five", *[t for _, t in items], items[3][1] + " " + items[4][1]]
    for _ in range(40):
        own = say(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            words = (rng.choice(items)[1] or "").split(" ")
            k = rng.randrange(len(words))
            own += " q " + " ".join(words[k : k + rng.randint(1, 60)]) + " " + say(3)
        docs.append(own)
    docs.append(" ".join(docs[5:15]) * 60)  # very long
    return [(k, t) for k, t in enumerate(docs)] + [(3, docs[3]), (None, docs[4])], items


def check(rows, docs, items):
    got = sorted((-1 if r.row.doc_id is None else r.row.doc_id, r.n_words, sum(s.length for s in r.spans), tuple(sorted((m.item_id, m.length) for m in r.matches))) for r in rows)
    want = []
    for i, t in docs:
        n, hit, found = plain(t, items)
        want.append((-1 if i is None else i, n, len(hit), tuple(sorted(found.items()))))
    assert got == sorted(want)


@pytest.mark.parametrize("block_bytes", [suffix_match.BLOCK_BYTES, 400])
def test_matches_are_those_of_plain_loops(spark, tables, block_bytes):
    docs, items = tables
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"spans": F.lit(1), "row": F.lit("x"), "n_words": F.lit(None).cast("string")}).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = suffix_match.matched(df, bench, block_bytes=block_bytes).collect()
    check(rows, docs, items)
    texts = dict(docs)
    for r in rows:
        words = split(texts[r.row.doc_id])
        for m in r.matches:  # the places are right
            sources = [split(t) for i, t in items if str("" if i is None else i) == m.item_id]
            assert any(words[m.start : m.start + m.length] == s[m.item_start : m.item_start + m.length] for s in sources)


def test_shards_of_one_document_and_the_kept(spark, tables, monkeypatch):
    docs, items = tables
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    kept = sorted(str(r.doc_id) for r in suffix_match.decontaminated(df, bench).collect())
    assert kept == sorted(str(i) for i, t in docs if not plain(t, items)[1])
    assert suffix_match.decontaminated(df, bench).columns == ["doc_id", "text"]


def test_nothing(spark, tables):
    docs, items = tables
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert suffix_match.matched(df.limit(0), bench).count() == 0
    assert all(not r.spans and not r.matches for r in suffix_match.matched(df, bench.limit(0)).collect())


@pytest.mark.parametrize("packed", [1, 2, 4])
def test_suffix_array_is_sorted(packed):
    rng = np.random.default_rng(packed)
    words = rng.integers(0, 4, 3000)
    words[1000:1400] = words[100:500]
    array, _ = suffix_match.suffix_array(words, 64, packed, 2)
    text = words.tolist()
    until = [0] * (len(text) + 1)  # where the next breaker is
    until[-1] = len(text)
    for i in range(len(text) - 1, -1, -1):
        until[i] = i if text[i] == 0 else until[i + 1]
    own = [text[i : min(until[i], i + 64)] for i in array.tolist()]
    assert sorted(array.tolist()) == [i for i, w in enumerate(text) if w]
    assert all(a <= b for a, b in zip(own, own[1:]))


def test_query(spark, tables, tmp_path):
    docs, items = tables
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in op12(spark, str(tmp_path)).where("doc_id is not null").collect())
    want = []
    for i, t in docs:
        if i is not None:
            n, hit, found = plain(t, items)
            want.append((i, n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
