import hashlib

import numpy as np

from llm import syncmers
from llm_fixtures import no_docs, odd_docs, odd_texts, words  # noqa: F401


def test_anchors_by_brute_force(odd_texts):
    for t in odd_texts[:40]:
        b = (t or "").encode()[:3000]
        at, whole = syncmers.anchors(b)
        if len(b) < syncmers.K:
            assert len(at) == (1 if b else 0)
            continue

        def smer(i):
            x = (int.from_bytes(b[i : i + syncmers.S], "big") + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 % 2**64  # noqa: B023
            return x ^ x >> 31

        h = [smer(i) for i in range(len(b) - syncmers.S + 1)]
        w = syncmers.K - syncmers.S + 1
        assert at.tolist() == [i for i in range(len(b) - syncmers.K + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])]
        same = {}
        for i, x in zip(at.tolist(), whole.tolist(), strict=True):
            assert same.setdefault(b[i : i + syncmers.K], x) == x
        assert len(set(same.values())) == len(same)


def test_anchors_depend_on_their_own_bytes_only():
    rng = np.random.default_rng(1)
    a = bytes(rng.integers(97, 123, 400, dtype=np.uint8))
    changed = a[:200] + b"#" + a[201:]
    mine, theirs = (dict(zip(*map(list, syncmers.anchors(x)), strict=True)) for x in (a, changed))
    far = lambda d: {k: v for k, v in d.items() if k + syncmers.K <= 200 or k > 200}
    assert far(mine) == far(theirs) and len(mine) > 50


def test_neighbours_by_brute_force(spark, odd_docs, odd_texts):
    want = {}
    texts = [t or "" for t in odd_texts]
    for i, t in enumerate(texts):
        following = texts[i - 1]
        want[3 * i] = (t, syncmers.edited(t, following), following)
    for range_rows in (7, 10_000):
        got = syncmers.with_neighbours(odd_docs.repartition(5), range_rows=range_rows).collect()
        assert len(got) == len(want)
        for r in got:
            t, e, f = want[r.doc_id]
            mark, changed, other = (syncmers.fingerprint(x.encode()) for x in (t, e, f))
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (syncmers.text_of(mark), syncmers.text_of(changed))
            assert (r.near_edited, r.near_next) == (syncmers.likeness(mark, changed), syncmers.likeness(mark, other))


def test_likeness(words):
    text = " ".join(words).encode()
    a, b = syncmers.fingerprint(text), syncmers.fingerprint(" ".join(reversed(words)).encode())
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness(a, b) < 0.9 and syncmers.likeness(a, a[:0]) == 0 and syncmers.likeness(a[:0], a[:0]) == 1


def test_ties_nulls_and_nothing(spark, no_docs):
    assert syncmers.with_neighbours(no_docs).count() == 0
    one = syncmers.with_neighbours(spark.createDataFrame([(1, "alone in here")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "n"), (2, None), (None, "m")]
    got = syncmers.with_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string"), range_rows=2).collect()
    assert len(got) == 6
