import bisect
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import packing, token_files
from llm.queries import tokenizer_path
from llm.rans import Coder, frequencies
from llm.token_rows import tokenised
from llm.tokens import Encoder
from llm_fixtures import no_docs, odd_docs, odd_texts, words  # noqa: F401

ODD = [
    "", " ", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "ΟΔΟΣ Σ ΑΣ.", "éa ́b", "İstanbul ıI", "a\x1cb\x85c\xa0d e　f", "it's WE'LL 'S ''s",
    "１２ ½ ²x", "ﬁ ß ẞ Ǆ", "日本語 テスト", "👩‍👩‍👧 a", "a\x00b", "ªº µ", "x­y", "don'T'RE", "end... of!!! (this)", "tab\tand\r\nline", "ab12cd",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, texts, end=None):
    out = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [x + [end] if end is not None else x for x in out]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_is_the_library(library, odd_texts):
    encoder = Encoder(tokenizer_path(), most_words=50)
    texts = ODD + [t or "" for t in odd_texts]
    for _ in range(2):  # with an empty and with a used cache
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_all(pa.array(texts))]
        assert got == ids_of(library, texts)
    assert encoder.encode_all(pa.array([None, "a"]))[0] == b"" and encoder.encode_all(pa.array([], pa.string())) == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_000).astype(np.uint32)
    freq = frequencies(np.bincount(ids, minlength=3))
    assert freq.sum() == (1 << 20 if n else 0)
    coder = Coder(freq)
    block = coder.encode(ids, lanes=64, every=16)
    assert coder.decode(block).tolist() == ids.tolist()
    if n > 4 * 64 * 16:  # from a checkpoint
        assert coder.decode(block, 2, 4).tolist() == ids[2 * 64 * 16 : 4 * 64 * 16].tolist()
        with pytest.raises(ValueError):
            coder.decode(block[:-8] + b"\0" * 8)


def test_rans_words_follow_the_definition():
    """The words of a block, by the definition with one division a symbol, lane by lane."""
    ids = np.minimum(np.random.default_rng(8).zipf(1.1, 2_003), 40).astype(np.uint32)
    coder, lanes = Coder(frequencies(np.bincount(ids))), 16
    states, words = [1 << 31] * lanes, []
    for t in range(-(-len(ids) // lanes) - 1, -1, -1):
        given = []
        for lane, i in enumerate(ids[t * lanes : (t + 1) * lanes].tolist()):
            x, f, c = states[lane], int(coder.freq[i]), int(coder.start[i])
            if x >= f << 43:
                given.append(x & 0xFFFFFFFF)
                x >>= 32
            states[lane] = (x // f << 20) + x % f + c
        words = given + words
    block = coder.encode(ids, lanes=lanes, every=8)
    assert words and np.frombuffer(block, "<u4", len(words), len(block) - 4 * len(words)).tolist() == words
    assert coder.decode(block).tolist() == ids.tolist()


def test_generations_keep_what_is_in_use():
    from llm.tokens import Generations

    kept = Generations(2)
    kept.new.update(a=1, b=2, c=3)
    assert kept.missing({"a", "x"}) == {"x"} and kept.new == {"a": 1} and set(kept.old) == {"a", "b", "c"}


def test_files_round_trip(spark, library, odd_docs, odd_texts, tmp_path):
    path = str(tmp_path / "files")
    token_files.write(odd_docs, path, tokenizer_path(), end_id=2, block_ids=3000, range_ids=20_000)
    want, start = [], 0
    for i, ids in enumerate(ids_of(library, odd_texts, 2)):
        want.append((3 * i, start, len(ids), crc(ids)))
        start += len(ids)
    got = token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    assert sorted(map(tuple, got.collect())) == want
    assert spark.read.parquet(path + "/blocks").count() > 3


def test_files_of_nothing_and_null_ids(spark, no_docs, tmp_path):
    token_files.write(no_docs, str(tmp_path / "a"), tokenizer_path(), end_id=2)
    assert token_files.read(spark, str(tmp_path / "a")).count() == 0
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id bigint, text string")
    token_files.write(df, str(tmp_path / "b"), tokenizer_path(), end_id=2)
    rows = sorted(token_files.read(spark, str(tmp_path / "b")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1] and [r.start for r in rows] == [0, 2, 4]


def test_packing(spark, library, odd_docs, odd_texts):
    got = packing.packed_documents(odd_docs, tokenizer_path(), end_id=0, size=256).collect()
    sequences = {}
    each = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        each.setdefault(r.doc_id, []).append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = 0
    for i, ids in enumerate(ids_of(library, odd_texts, 0)):
        parts = sorted(each[3 * i], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 256))
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in parts) and sum(r.length for r in parts) == len(ids)
        total += len(ids)
    assert len(sequences) <= -(-total // 256) + 2


def test_packing_encodes_few_bytes_at_once(spark, odd_docs, monkeypatch):
    """A worker's memory follows the bytes that it encodes at once, whatever a batch holds."""
    from llm import token_rows

    asked, encoded = [], token_rows.encoded
    monkeypatch.setattr(token_rows, "encoded", lambda *a: asked.append(a[2]) or encoded(*a))
    batch = pa.RecordBatch.from_pydict({"id": list(range(60)), "text": ["ab cd " * 20_000] * 60})
    monkeypatch.setattr(type(odd_docs), "mapInArrow", lambda self, run, schema: list(run([batch])))
    found = packing.pieces(odd_docs, tokenizer_path(), 0, 2048)
    assert asked == [2_000_000] and len(found) == 4 and sum(b.column("length").to_numpy().sum() for b in found) >= 60 * 40_000


def test_sequences_hold_the_ids(spark, odd_docs):
    some = odd_docs.limit(40)
    tokens = tokenised(some, tokenizer_path(), 0)
    placed = packing.packed_documents(some, tokenizer_path(), end_id=0, size=128)
    rows = packing.sequences(tokens, placed).collect()
    assert sum(len(r.ids) for r in rows) == 4 * placed.agg(F.sum("length")).first()[0] and all(len(r.ids) <= 512 and r.starts[0] == 0 for r in rows)


def test_packing_of_equal_and_no_rows(spark, no_docs):
    assert packing.packed_documents(no_docs, tokenizer_path()).count() == 0
    df = spark.createDataFrame([(1, "a b c")] * 50 + [(None, None)], "doc_id bigint, text string")
    got = packing.packed_documents(df, tokenizer_path(), size=8).collect()
    assert len(got) == 51 and len({(r.sequence_id, r.offset) for r in got}) == 51


@pytest.mark.parametrize("shape", ["even", "short", "many"])
def test_sums_of_squares_fill_well(shape):
    rng = np.random.default_rng(3)
    lengths = {"even": rng.integers(1, 2048, 4000), "short": rng.integers(1, 300, 5000), "many": np.minimum(2047, 1 + rng.exponential(600, 6000).astype(int))}[shape]
    lengths = np.sort(lengths)[::-1]
    gaps, plain = [], 0  # best-fit decreasing
    for s in lengths.tolist():
        at = bisect.bisect_left(gaps, s)
        plain, gap = (plain, gaps.pop(at)) if at < len(gaps) else (plain + 1, 2048)
        if gap > s:
            bisect.insort(gaps, gap - s)
    used = min(int(packing.sums_of_squares(lengths, 2048, fill)[0].max()) + 1 for fill in (0.25, 1.0))
    assert used <= 1.005 * plain + 1
