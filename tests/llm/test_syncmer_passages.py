import random

from llm import syncmers


def text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_a_short_passage_of_long_texts_is_found_at_its_places():
    passage, a, b = text(1, 50), text(2, 18_000), text(3, 18_000)
    one, two = (a[:50_000] + passage + a[50_000:]).encode(), (b[:9_000] + passage + b[9_000:]).encode()
    found = syncmers.passages(one, two)
    start, other, size = max(found.tolist(), key=lambda x: x[2])
    assert size > len(passage) - 40 and abs(start - 50_000) < 30 and start - other == 41_000
    assert one[start : start + size] == two[other : other + size]
    assert len(passage) - 40 < syncmers.shared_bytes(found) < len(passage) + 100
    assert syncmers.shared_bytes(syncmers.passages(a.encode(), b.encode())) < 100


def test_every_passage_is_the_same_in_both():
    base = text(4, 300)
    for seed in range(5):
        rng = random.Random(seed)
        at = sorted(rng.sample(range(len(base)), 4))
        one, two = base.encode(), (base[at[1] : at[3]] + " new " + base[: at[2]] + base[: at[0]]).encode()
        found = syncmers.passages(one, two)
        assert len(found) and all(one[i : i + n] == two[j : j + n] for i, j, n in found.tolist())
        assert 0 < syncmers.shared_bytes(found) <= len(one)
    assert syncmers.shared_bytes(syncmers.passages(b"short", b"short")) == 5
    assert syncmers.shared_bytes(syncmers.passages(b"", b"")) == syncmers.shared_bytes(syncmers.passages(b"short", b"other")) == 0


def test_neighbours_have_their_shared_bytes(spark):
    passage = text(5, 50)
    texts = {3: text(6, 4_000) + passage, 2: passage + text(7, 4_000), 1: text(8, 200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in syncmers.with_neighbours(df).collect()}
    assert got[3].shared_next > len(passage) - 40 and got[2].shared_next < 50
    assert abs(got[1].shared_edited - got[1].n_chars * 2 / 3) < 60


def test_a_passage_shows_in_fingerprints_of_any_length():
    """Recall of shared passages of 50 words by likeness above that of unrelated texts."""
    for n in (150, 1_500, 30_000):  # about 1,000, 10,000 and 200,000 bytes
        caught = 0
        for seed in range(20):
            passage, a, b = text(100 + seed, 50), text(200 + seed, n), text(300 + seed, n)
            one, two = (f"{x[: len(x) // 2]} {passage} {x[len(x) // 2 :]}".encode() for x in (a, b))
            mine, theirs = syncmers.fingerprint(one), syncmers.fingerprint(two)
            caught += syncmers.likeness(mine, theirs) > syncmers.likeness(syncmers.fingerprint(a.encode()), syncmers.fingerprint(b.encode()))
        assert caught >= 19, n
