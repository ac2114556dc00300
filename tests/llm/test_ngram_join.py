import random

import pytest
from pyspark.sql import functions as F

from llm import ngram_join
from llm_fixtures import no_docs, odd_texts, words  # noqa: F401


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(rows, size, percent):
    sets = sets_of(rows, size)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, size, percent, parts=4):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(df, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_odd_texts(spark, odd_texts):
    rows = list(enumerate(odd_texts))
    check(spark, rows, 4, 85)
    check(spark, rows, 5, 80, parts=1)


def near_copies(words, seed, groups=6, copies=25):
    """Groups whose members differ by a few up to many words: many pairs near the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 15, 30, 70, 140, 300]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                k = rng.randrange(len(t))
                t[k : k + rng.choice([0, 1, 1])] = [rng.choice(words)]
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_near_the_threshold(spark, words, seed, monkeypatch):
    rows = near_copies(words, seed)
    check(spark, rows, 4, 85)
    monkeypatch.setattr(ngram_join, "RARE", 1)  # all shared tokens take the way of frequent ones
    check(spark, rows, 4, 85)


def test_blocks_of_clusters(spark, words):
    """The comparison in blocks finds the same links as comparing all pairs."""
    rows = near_copies(words, 9, groups=2, copies=40)
    sets = sets_of(rows, 4)
    hashed = ngram_join.Words()
    table = [(i, len(sets[i]), i, 0, bytearray(ngram_join.shingles(t.encode().lower().split(), 4, hashed).tobytes())) for i, t in rows]
    df = spark.createDataFrame(table, "head bigint, n bigint, component bigint, cluster bigint, tokens binary")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in ngram_join._in_blocks(df.drop("tokens"), df.select("head", "tokens"), 85, block=8).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert got == want


def test_nulls_repeats_and_nothing(spark, no_docs):
    assert ngram_join.joined(no_docs).count() == 0
    rows = [(None, "a b c d e"), (4, "A B C D E"), (4, "a b c d e"), (None, None), (9, "")]
    got = ngram_join.joined(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tokens", F.lit(1))).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert found == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (9, 0, 9)], key=str)


def test_links_of_large_groups_of_near_copies_grow_with_the_rows(spark, words, monkeypatch):
    """A group's links number fewer than the rows its tasks read, and join what all links join."""
    rng, base, rows = random.Random(4), [f"w{k}" for k in range(60)], []
    for i in range(300):
        t = list(base)
        t[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(t)))
    made, blocks = [], ngram_join._in_blocks

    def counted(clusters, sets, percent, **options):
        links = blocks(clusters, sets, percent, **options)
        made.append((links.count(), clusters.count()))
        return links

    monkeypatch.setattr(ngram_join, "_in_blocks", counted)
    check(spark, rows, 5, 80)
    assert made and all(n < read for n, read in made)


def test_spanning_links():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 400):
        x, y = rng.integers(0, 50, n) * 7, rng.integers(0, 50, n) * 7 + 3 * (n == 60)

        def joined(x, y, nodes):
            root = {v: v for v in nodes}
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)

            def top(v):
                return v if root[v] == v else top(root[v])

            return {v: top(v) for v in nodes}

        nodes = {*x.tolist(), *y.tolist()}
        some = ngram_join._spanning(x, y)
        groups = joined(x, y, nodes)
        assert joined(x[some], y[some], nodes) == groups
        assert len(some) == len(nodes) - len(set(groups.values()))


def test_hot_tokens_come_last_and_change_nothing(spark, words, monkeypatch):
    """Common lines make no clusters of texts that are not alike, and the links are those of all pairs."""
    rng = random.Random(5)
    common = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(2)]
    rows = [(i, " ".join([rng.choice(common), *(f"w{rng.randrange(10**9)}" for _ in range(60))])) for i in range(120)]
    rows += [(200 + i, t) for i, t in near_copies(words, 3, groups=3, copies=12)]
    made, blocks = [], ngram_join._in_blocks

    def counted(clusters, sets, percent, **options):
        made.append(clusters.where("n < 70 and n > 60").count())
        return blocks(clusters, sets, percent, **options)

    monkeypatch.setattr(ngram_join, "_in_blocks", counted)
    monkeypatch.setattr(ngram_join, "SAMPLED", 1)
    check(spark, rows, 4, 85)
    check(spark, rows, 4, 50)
    assert not any(made)
    monkeypatch.setattr(ngram_join, "MOST_HOT", 5)
    check(spark, rows, 4, 85)
    for most in (1, 2):
        monkeypatch.setattr(ngram_join, "HOT", most)
        monkeypatch.setattr(ngram_join, "MOST_HOT", 1 << 21)
        check(spark, rows, 4, 85)


@pytest.mark.parametrize("rare", [1, 8])
def test_passes_find_what_one_pass_finds(spark, words, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "PASS_TOKENS", 1)
    seen, passes = [], ngram_join._passes
    monkeypatch.setattr(ngram_join, "_passes", lambda tokens, most: seen.append(min(passes(tokens, most), 5)) or seen[-1])
    rows = near_copies(words, 9, groups=2, copies=40)
    check(spark, rows, 4, 85)
    assert max(seen) > 1


def test_scratch_tables_and_shuffle_files_go(spark, words):
    """Only the result is left of what a join writes."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    found = ngram_join.similar_sets(spark.createDataFrame(near_copies(words, 1), "doc_id bigint, text string"))
    assert found.count()
    assert [x.partition("-")[0] for x in set(os.listdir(folder)) - before] == ["found"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
