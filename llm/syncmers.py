"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the smallest hash among its s-mers
is that of the first or of the last of them. Whether it is depends on the k-mer alone, so an
edit changes only anchors that overlap it, and anchors of two texts can be
matched by position. Ties count as smallest at an edge.

``fingerprint`` keeps, as hexadecimal digits, every syncmer hash below an eighth of the range, so that a
fingerprint grows with its text and a passage shows in it whatever the length of the rest; and the ``size``
smallest hashes at least, which is all that a short text has. ``likeness`` estimates the Jaccard similarity of the
syncmers of two texts from the hashes that both fingerprints hold completely.

``passages`` matches two texts by position, with all of their anchors: two neighbouring anchors and
the difference of their positions are a link, and a link that both texts have covers the same
bytes in both.

``with_neighbours`` pairs each document with the next one by descending id. Ranges of ids
are cut at ids that occur, and each range also gets the document that begins the next
one, so each task streams through sorted ranges and compares neighbours; texts are shuffled once.

Defined results: a null text counts as empty. A text shorter than a k-mer is one anchor as
a whole, an empty one has none; two empty fingerprints have likeness 1, an empty and
another one 0. Equal texts have equal fingerprints. Equal ids follow each other by text, and
null ids come last. A document alone in its table is followed by itself. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S, SIZE = 12, 4, 64
#: Hashes below this are kept, however many there are.
KEPT = (1 << 32) // 8


def anchors(text: bytes, k: int = K, s: int = S):
    """Positions and 64-bit hashes of the closed syncmers of ``text``."""
    import numpy as np

    n = len(text)
    if n < k:
        import xxhash

        some = 1 if n else 0
        return np.zeros(some, dtype=np.int64), np.array([xxhash.xxh3_64_intdigest(text)][:some], dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    short = np.zeros(n - s + 1, dtype=np.uint64)
    for j in range(s):
        short = (short << np.uint64(8)) | data[j : n - s + 1 + j]
    short = (short + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    short ^= short >> np.uint64(31)
    window = k - s + 1
    lowest = short[: n - k + 1].copy()
    for j in range(1, window):
        np.minimum(lowest, short[j : n - k + 1 + j], out=lowest)
    at = np.flatnonzero((short[: n - k + 1] == lowest) | (short[window - 1 :] == lowest))
    whole = np.zeros(len(at), dtype=np.uint64)
    for j in range(0, k, s):  # the s-mers that make up the k-mer, the last one overlapping if need be
        whole = (whole ^ short[at + min(j, k - s)]) * np.uint64(0x94D049BB133111EB)
        whole ^= whole >> np.uint64(29)
    return at, whole


def fingerprint(text: bytes, k: int = K, s: int = S, size: int = SIZE):
    """The distinct syncmer hashes, 32 bits each, sorted: all below ``KEPT``, and the smallest ``size`` at least."""
    import numpy as np

    every = np.unique((anchors(text, k, s)[1] >> np.uint64(32)).astype(np.uint32))
    return every[: max(size, int(np.searchsorted(every, KEPT)))]


def likeness(a, b, size: int = SIZE) -> float:
    """The share of common hashes among those below ``KEPT``, or among the ``size`` smallest if these reach further."""
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    both = both[: max(size, int(np.searchsorted(both, KEPT)))]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum()) / len(both)


def links(at, whole):
    """One hash for each anchor but the last: it, the next one and the difference of their positions."""
    import numpy as np

    mixed = (whole[:-1] ^ np.diff(at).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(31) ^ whole[1:]) * np.uint64(0x94D049BB133111EB)
    return mixed ^ mixed >> np.uint64(29)


def passages(text: bytes, other: bytes, k: int = K, s: int = S, found=None, its=None):
    """(start in ``text``, start in ``other``, bytes) of what links of both texts cover, by start in ``text``.

    Links that overlap at the same difference of positions are one passage. A link that ``other``
    has several times counts at its first place. ``found`` and ``its`` are the texts' anchors, if known.
    """
    import numpy as np

    if text == other:
        return np.array([(0, 0, len(text))] if text else [], dtype=np.int64).reshape(-1, 3)
    (at, whole), (there, theirs) = found or anchors(text, k, s), its or anchors(other, k, s)
    if len(at) < 2 or len(there) < 2:
        return np.zeros((0, 3), dtype=np.int64)
    mine = links(at, whole)
    known, first = np.unique(links(there, theirs), return_index=True)
    place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    common = np.flatnonzero(known[place] == mine)
    if not len(common):
        return np.zeros((0, 3), dtype=np.int64)
    begin, end, begin_other = at[common], at[common + 1] + k, there[first[place[common]]]
    joined = (begin[1:] < end[:-1]) & (np.diff(begin) == np.diff(begin_other))
    starts = np.flatnonzero(np.concatenate([[True], ~joined]))
    ends = np.append(starts[1:], len(common)) - 1
    return np.stack([begin[starts], begin_other[starts], end[ends] - begin[starts]], axis=1)


def shared_bytes(found) -> int:
    """How many bytes of the first text its passages cover, each counted once."""
    import numpy as np

    if not len(found):
        return 0
    end = found[:, 0] + found[:, 2]
    reached = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    return int(np.maximum(end - np.maximum(found[:, 0], reached), 0).sum())


def text_of(found) -> str:
    """A fingerprint as hexadecimal digits, eight for each hash."""
    return found.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the first as many characters of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def with_neighbours(docs: DataFrame, range_rows: int = 4_000, most_ranges: int = 2_000, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shared_edited, shared_next.

    The last two are bytes of the document in passages that the edited text, or the next document, has too.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_edited", "shared_next"]
        out = {name: [] for name in names}
        held = None

        def emit(row, text, mark, following, its):
            other = edited(text, following)
            changed = fingerprint(other.encode(), k, s, size)
            whole, own = text.encode(), anchors(text.encode(), k, s)
            shared = [shared_bytes(passages(whole, x.encode(), k, s, own)) for x in (other, following)]
            values = (row, len(text), hashlib.sha256(other.encode()).hexdigest(), text_of(mark), text_of(changed), likeness(mark, changed, size), likeness(mark, its, size), *shared)
            for name, value in zip(names, values, strict=True):
                out[name].append(value)

        def flush(kind):
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=names)
            for values in out.values():
                values.clear()
            return batch

        for batch in batches:
            kind = batch.column(3).type
            for span, after, text, i in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held is not None and held[0] != span:
                    held = None  # a range ends with the first document of the next one
                if after and held is None:
                    continue  # a further copy of the id that begins the next range
                mark = fingerprint(text.encode(), k, s, size)
                if held is not None:
                    emit(held[3], held[1], held[2], text, mark)
                held = None if after else (span, text, mark, i)
                if len(out["doc_id"]) >= 2_000:
                    yield flush(kind)
        if out["doc_id"]:
            yield flush(kind)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited bigint, shared_next bigint"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = rows.count()
    if not count:
        return rows.select("doc_id").mapInArrow(lambda batches: iter(()), schema)
    # the ids that begin ranges, highest first; a range is streamed, so its size bounds no memory
    ranges = min(most_ranges, max(1, -(-count // range_rows)))
    quantiles = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, quantiles)), F.lit(10 * ranges + 1000)).alias("q")).first().q if quantiles else None
    begins = sorted(set(cuts or []), reverse=True)
    highest = rows.agg(F.max("doc_id")).first()[0]
    begins = [b for b in begins if b != highest]
    # documents from begins[j - 1] on downwards belong to range j; null ids to the last one
    span = F.coalesce(sum(((F.col("doc_id") <= F.lit(b)).cast("int") for b in begins), F.lit(0)), F.lit(len(begins)))
    if len(begins) > 50:
        points = F.array(*[F.lit(b) for b in sorted(begins)])
        below = F.size(F.filter(points, lambda b: b < F.col("doc_id")))
        span = F.when(F.col("doc_id").isNull(), F.lit(len(begins))).otherwise(F.lit(len(begins)) - below)
    rows = rows.withColumn("span", span.cast("int"))
    first = F.col("doc_id").isin(begins) if begins else F.lit(False)
    start = F.col("doc_id").eqNullSafe(F.lit(highest))
    # the first of each range also ends the range before it, and the first of all ends the last range
    places = F.array(
        F.struct("span", F.lit(False).alias("after")),
        F.when(F.coalesce(first, F.lit(False)), F.struct((F.col("span") - 1).alias("span"), F.lit(True).alias("after"))),
        F.when(start, F.struct(F.lit(len(begins)).alias("span"), F.lit(True).alias("after"))),
    )
    dealt = rows.select("doc_id", "text", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("p.span", "p.after", "text", "doc_id")
    order = ["span", F.col("after").asc(), F.col("doc_id").desc_nulls_last(), "text"]
    return dealt.repartition("span").sortWithinPartitions(*order).mapInArrow(run, schema)
