import random

import pytest


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["the", "on", "er", "ing", "st", "ou", "ble", "ä", "ñ"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_texts(words):
    """Nulls, empty and blank texts, ties, repeated rows, odd signs, a very long text, copies and near copies."""
    rng = random.Random(6)
    base = [rng.choice(words) for _ in range(120)]
    texts = [None, "", " \t\n", "One", "one", "ONE", "two words", "Ünï ÜNÏ", "<|endoftext|> x", "a\x0bb\x1cc\x85d", " ".join(base), " ".join(base).upper()]
    for changes in (1, 2, 5, 20):
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    for _ in range(60):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))))
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i * 3, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
