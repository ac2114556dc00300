"""N-gram Jaccard join with prefixes of token combinations.

A document's tokens are the distinct shingles of its words, hashed to 64 bits; all
documents order tokens alike: by hash, hot ones last. Tokens are hot that several documents of a
sample have (and those with the same first bits); which they are changes no result, but common
lines seldom come into a prefix. A partner of a document with n tokens misses at most
e = floor((1 - t) n) of them, t being the threshold. Its prefix has e + 1 + m tokens, so
the partner shares at least m + 1 of them; and if the partner's prefix ends later,
as one of the two does, these lie in its prefix as well. So:

* rare tokens of prefixes are indexed one by one;
* frequent tokens fall into m classes by hash, and two tokens of one class are indexed
  together. If no rare token is shared, m + 1 shared frequent tokens cannot all be in
  different classes. m is fixed for documents of a size band, and documents at the edge
  of a band are indexed for both; the smallest documents (m = 0) index all tokens singly.

Tokens that occur once are found by an exchange of sorted hashes, one array for each
task and hash range, and go no further; nor do documents with fewer than m + 1 shared
prefix tokens. Documents with the same tokens count once, as a class.

Candidates: rare tokens give pairs, of which those remain that can share m + 1 tokens.
A combination may be common to any number of documents, so first only its leader is
paired with the others. Most groups are then one component and done with. Where a
combination still joins several components, its documents form a cluster, cut into
blocks by size. Blocks are compared in themselves first, which joins large groups of near
copies; of what is open after that, pairs of blocks go to tasks, which compare what is not
yet in one component. A task returns no more links than join what its links join, fewer
than the documents it reads. No list of all pairs is made, and every pair that could be
linked is compared or already joined. Candidates are verified on their whole texts' shingles.
What verifying shuffles is cut into passes, each a part of the size of all tokens. Scratch tables and shuffle
files go as soon as they have been read.

Defined results: without words or text a document has no token and is linked with
nothing; with fewer words than a shingle the whole sequence is one. Equal rows are
copies. A component's id is the smallest id in it; null ids never are, unless there is no
other. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import Scratch, free, shuffles_freed
from llm.components import components

#: Tokens in more classes of documents than this are indexed in pairs.
RARE = 8
#: Hot tokens are in ``HOT`` documents or more of a sample of one in ``SAMPLED``; at most ``MOST_HOT`` of them.
SAMPLED, HOT, MOST_HOT = 16, 4, 1 << 21
#: Hot tokens are marked by their first bits.
HOT_BITS = 24
#: Shingles that a pass of the verification shuffles at least.
PASS_TOKENS = 16_000_000


class Words:
    """64-bit hashes of words, kept for words seen before; bounded."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def hashes(self, words: list[bytes]):
        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: list[bytes], size: int, hashed: Words):
    """The distinct shingles of a text as sorted 64-bit hashes."""
    import numpy as np

    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashed.hashes(words)
    n = max(1, len(h) - size + 1)
    x = np.full(n, len(h) if len(h) < size else size, dtype=np.uint64)
    for k in range(min(size, len(h))):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def _missing(n: int, percent: int) -> int:
    """How many tokens a partner may lack."""
    return n - -(-n * percent // 100)


def _classes(n: int) -> int:
    """m of the largest band of a document with n tokens."""
    return 1 << (n.bit_length() - 4) if n >= 8 else 0


def _hot(docs: DataFrame, size: int, text_col: str, scratch: Scratch) -> bytes:
    """A bitmap of the first bits of tokens that several documents of a sample have."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from llm.common import utf8_bytes
        from llm.tokens import in_batches

        hashed = Words(100_000)
        for batch in batches:
            for a, b in in_batches(batch.column(0), 2_000_000):
                sets = [shingles(t.lower().split(), size, hashed) for t in utf8_bytes(batch.column(0).slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    some = docs.select(F.col(text_col).alias("text")).sample(1 / SAMPLED, 0) if SAMPLED > 1 else docs.select(F.col(text_col).alias("text"))
    often = scratch.cut(some.mapInArrow(run, "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= HOT), "often")
    least, total = HOT, 0
    for r in often.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).collect():  # 10,000 rows at most
        total += r.tokens
        if total > MOST_HOT:
            least = r.n + 1
            break
    marks = _bitmap(often.where(F.col("n") >= least).select(F.shiftrightunsigned("token", 64 - HOT_BITS).alias("bit")), 1 << HOT_BITS)
    scratch.free(often)
    return marks


def _ordered(tokens, marks):
    """Sorted tokens in the order of prefixes: the hot ones last."""
    import numpy as np

    bit = (tokens >> np.uint64(64 - HOT_BITS)).astype(np.int64)
    hot = ((marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
    return np.concatenate([tokens[~hot], tokens[hot]]) if hot.any() else tokens


def _scan(docs: DataFrame, size: int, percent: int, ranges: int, id_col: str, text_col: str, marks: bytes, chunk_bytes: int = 16_000_000) -> DataFrame:
    """Rows of three kinds: 0 documents, 1 prefix tokens by hash range, 2 tokens shared inside a chunk."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from llm.common import utf8_bytes

        hashed, base, kind = Words(), TaskContext.get().partitionId() << 36, None
        hot = np.frombuffer(shared.value, dtype=np.uint8)
        shift = np.uint64(64 - ranges.bit_length() + 1)

        def table(rows, **columns):
            types = {"kind": pa.int32(), "key": pa.int64(), "doc_id": kind, "n": pa.int64(), "same": pa.binary(), "span": pa.int64(), "token": pa.int64(), "tokens": pa.binary(), "places": pa.binary()}
            return pa.RecordBatch.from_pydict({name: pa.array(columns[name], t) if name in columns else pa.nulls(rows, t) for name, t in types.items()})

        def flush(ids, texts):
            sets, first, same = [], {}, []
            for text in texts:
                s = shingles(text.lower().split(), size, hashed)
                sets.append(s)
                same.append(hashlib.md5(s.tobytes()).digest())
            for i, digest in enumerate(same):
                first.setdefault(digest, i)
            rows = len(ids)
            yield table(rows, kind=[0] * rows, key=range(base, base + rows), doc_id=ids, n=[len(s) for s in sets], same=same)
            tokens, places = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint32)]
            for i in first.values():
                prefix = _ordered(sets[i], hot)[: _missing(len(sets[i]), percent) + 1 + _classes(len(sets[i]))]
                tokens.append(prefix)
                places.append(np.full(len(prefix), i, dtype=np.uint32))
            tokens, places = np.concatenate(tokens), np.concatenate(places)
            sort = np.argsort(tokens, kind="stable")
            tokens, places = tokens[sort], places[sort]
            again = np.zeros(len(tokens), dtype=bool)
            again[1:] = tokens[1:] == tokens[:-1]
            shared = again.copy()
            shared[:-1] |= again[1:]
            if shared.any():
                keys, token = base + places[shared].astype(np.int64), tokens[shared].view(np.int64)
                yield table(len(keys), kind=np.full(len(keys), 2), key=keys, token=token)
            # of a token shared here, one copy without a place tells the other chunks
            places[shared] = 0xFFFFFFFF
            tokens, places = tokens[~again], places[~again]
            span = (tokens >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]])) if len(span) else []
            ends = [*cuts[1:], len(span)]
            parts = [(tokens[a:b].tobytes(), places[a:b].tobytes()) for a, b in zip(cuts, ends, strict=False)] if len(span) else []
            yield table(len(parts), kind=[1] * len(parts), key=[base] * len(parts), span=span[cuts] if len(span) else [], tokens=[p[0] for p in parts], places=[p[1] for p in parts])

        ids, texts, held = [], [], 0
        for batch in batches:
            kind = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), utf8_bytes(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= chunk_bytes:
                    yield from flush(ids, texts)
                    base += len(ids)
                    ids, texts, held = [], [], 0
        if ids:
            yield from flush(ids, texts)

    schema = T.StructType.fromDDL("kind int, key bigint").add("doc_id", docs.schema[id_col].dataType)
    for field in T.StructType.fromDDL("n bigint, same binary, span bigint, token bigint, tokens binary, places binary"):
        schema.add(field)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _shared(spans: DataFrame) -> DataFrame:
    """(token, key) of the tokens that more than one chunk has."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        base, tokens, places = table.column("key").to_pylist(), table.column("tokens").to_pylist(), table.column("places").to_pylist()
        token = np.frombuffer(b"".join(tokens), dtype=np.uint64)
        place = np.frombuffer(b"".join(places), dtype=np.uint32)
        keys = np.repeat(np.array(base, dtype=np.int64), [len(t) // 8 for t in tokens]) + place
        sort = np.argsort(token, kind="stable")
        token, keys, place = token[sort], keys[sort], place[sort]
        again = np.zeros(len(token), dtype=bool)
        again[1:] = token[1:] == token[:-1]
        again[:-1] |= again[1:]
        again &= place != 0xFFFFFFFF
        return pa.Table.from_pydict({"token": token[again].view(np.int64), "key": keys[again]})

    return spans.groupBy("span").applyInArrow(run, "token bigint, key bigint")


def _bitmap(ids: DataFrame, bits: int):
    """A bitmap of ``bits`` bits, those in the column ``bit`` set, one byte string; combined on the way."""
    parts = ids.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("map"))
    out = bytearray(bits // 8)
    for r in parts.collect():  # bits / 32768 rows at most
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.map
    return bytes(out)


def _texts(docs: DataFrame, members: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str, count: int) -> DataFrame:
    """(head, tokens) of the wanted classes: the shingles of the whole text of one document each.

    A bitmap of bounded size tells which documents may be wanted, so that hardly any other
    is prepared and shuffled; the join then takes exactly the wanted ones.
    """
    bits = 1 << 15
    while bits < min(16 * count, 1 << 27):
        bits *= 2
    heads = members.where("key = head").join(wanted, "head", "left_semi").select("head", "same", F.col("doc_id").alias("_id"))
    marks = _bitmap(heads.select(F.pmod(F.xxhash64("_id"), F.lit(bits)).alias("bit")), bits)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from llm.common import utf8_bytes

        hashed, map_ = Words(), np.frombuffer(marks, dtype=np.uint8)
        for batch in batches:
            bit = batch.column(1).to_numpy()
            chosen = (map_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            texts = batch.column(0).filter(pc.cast(pa.array(chosen), pa.bool_()))
            sets = [shingles(t.lower().split(), size, hashed).tobytes() for t in utf8_bytes(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["same", "tokens"])

    texts = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(docs[id_col]), F.lit(bits)).alias("bit"))
    sets = texts.mapInArrow(run, "same binary, tokens binary").join(heads.select("same"), "same", "left_semi").dropDuplicates(["same"])
    return heads.select("head", "same").join(sets, "same").select("head", "tokens")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = sets.select(F.col("head").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("head").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _spanning(x, y):
    """Places in the links (x, y) of as few as join all nodes that these join."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    label, at, kept = np.arange(len(nodes)), np.arange(len(x)), []
    x, y = ends[: len(x)], ends[len(x) :]
    while len(at):
        # each root that is linked with a smaller one hooks to one of these
        high, first = np.unique(np.maximum(label[x[at]], label[y[at]]), return_index=True)
        low = np.minimum(label[x[at]], label[y[at]])[first]
        high, low, first = high[low < high], low[low < high], first[low < high]
        kept.append(at[first])
        label[high] = low
        while (label[label] != label).any():
            label = label[label]
        at = at[label[x[at]] != label[y[at]]]
    return np.concatenate(kept) if kept else at


def _blocks(clusters: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their steps of size and the number of blocks of it, and these numbers; ``tokens``: of all rows of a step."""
    # sizes of linked documents are in the same or in neighbouring steps of the threshold
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    rows = clusters.withColumn("step", step)
    counts = rows.groupBy("cluster", "step").agg(F.ceil(F.count("*") / block).alias("blocks"), F.sum("n").alias("tokens"))
    return rows.join(counts.drop("tokens"), ["cluster", "step"]), counts


def _passes(tokens: int, most: int) -> int:
    """How many passes shuffle so many tokens."""
    return max(1, -(-tokens // most))


def _across(clusters: DataFrame, percent: int, block: int = 256) -> int:
    """The tokens that comparing the blocks with each other shuffles."""
    _, counts = _blocks(clusters, percent, block)
    near = counts.select("cluster", F.col("step").alias("other"), F.col("blocks").alias("others"))
    met = counts.join(near, (counts["cluster"] == near["cluster"]) & (near["other"].between(counts["step"] - 1, counts["step"] + 1)))
    return met.agg(F.coalesce(F.sum(F.col("tokens") * F.col("others")), F.lit(0))).first()[0]


def _in_blocks(
    clusters: DataFrame, sets: DataFrame, percent: int, block: int = 256, within: bool = False, spanning: bool = False, passes: int = 1, number: int = 0
) -> DataFrame:
    """Links (a, b) between different components of each cluster. ``clusters``: cluster, head, n, component.

    ``within`` compares each block with itself only. With ``spanning`` a task returns only as many links as join the
    components that its links join. Of several ``passes``, each compares its part of the pairs of blocks.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        side, head, part = (table.column(c).to_numpy() for c in ("side", "head", "component"))
        sets = [np.frombuffer(t, dtype=np.uint64) for t in table.column("tokens").to_pylist()]
        size = np.array([len(t) for t in sets])
        row, token = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
        _, column, times = np.unique(token, return_inverse=True, return_counts=True)
        used = times > 1
        column, row = (np.cumsum(used) - 1)[column[used[column]]], row[used[column]]
        sort = np.argsort(column, kind="stable")
        column, row = column[sort], row[sort]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for at in range(0, int(used.sum()), 8192):
            i, j = np.searchsorted(column, [at, at + 8192])
            m = np.zeros((len(sets), 8192), dtype=np.float32)
            m[row[i:j], column[i:j] - at] = 1
            both += m[left] @ m[right].T
        union = size[left][:, None] + size[right][None, :] - both
        fits = (100 * both >= percent * union) & (part[left][:, None] != part[right][None, :])
        p, q = np.nonzero(fits)
        if spanning:
            some = _spanning(part[left][p], part[right][q])
            p, q = p[some], q[some]
        return pa.Table.from_pydict({"a": head[left][p], "b": head[right][q]})

    rows, counts = _blocks(clusters, percent, block)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("head"), F.col("blocks")))
    me = F.struct("step", "own")
    if within:
        rows = rows.withColumns({"low": me, "high": me, "side": F.lit(2)})
    else:
        near = counts.select("cluster", F.col("step").alias("other"), F.col("blocks").alias("others"))
        rows = rows.join(near, (rows["cluster"] == near["cluster"]) & (near["other"].between(rows["step"] - 1, rows["step"] + 1))).drop(near["cluster"])
        rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        you = F.struct(F.col("other").alias("step"), F.col("partner").alias("own"))
        rows = rows.withColumns({"low": F.least(me, you), "high": F.greatest(me, you), "side": F.when(me == you, 2).when(me < you, 0).otherwise(1)})
    if passes > 1:
        rows = rows.where(F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(passes)) == number)
    # by sorting: Spark would take the exploded rows for few and broadcast them
    rows = rows.join(sets.hint("merge"), "head").select("cluster", "low", "high", "side", "head", "component", "tokens")
    return rows.groupBy("cluster", "low", "high").applyInArrow(run, "a bigint, b bigint")


def _band(n: Column) -> Column:
    """m of the band of a size: a power of two of about an eighth of it, 0 for the smallest."""
    return F.when(n < 8, 0).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double") + 0.5)) - 3)).cast("long")


def similar_sets(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key, doc_id, n (tokens), head (of its class of copies), component (smallest head)."""
    with shuffles_freed(docs.sparkSession):
        return _similar_sets(docs, size, percent, id_col, text_col)


def _similar_sets(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    from barweave.session import scratch_path

    spark, count = docs.sparkSession, docs.count()
    scratch = Scratch(spark)
    ranges = 64
    while ranges * 10_000 < count:
        ranges *= 2
    path = scratch_path(spark, "join-scan")
    scan = _scan(docs, size, percent, ranges, id_col, text_col, _hot(docs, size, text_col, scratch))
    scan.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    kind_of = lambda k: spark.read.schema(scan.schema).parquet(path).where(F.col("kind") == k)

    shared = scratch.cut(_shared(kind_of(1).select("span", "key", "tokens", "places")), "shared")
    free(spark, f"{path}/kind=1")
    every = kind_of(0).select("key", "doc_id", "n", "same")
    heads = every.where("n > 0").groupBy("same").agg(F.min("key").alias("head"), F.count("*").alias("copies"))
    members = every.join(heads, "same", "left").select("key", "doc_id", "n", "same", F.coalesce("head", "key").alias("head"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = scratch.cut(members, "members")

    tokens = kind_of(2).select("token", "key").union(shared)
    postings = scratch.cut(tokens.join(members.select("key", "head", "n", "copies"), "key").select("token", "head", "n", "copies").distinct(), "postings")
    scratch.free(shared)
    free(spark, path)
    often = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posted = postings.join(often, "token").withColumn("rare", F.col("df") <= RARE)
    smaller = F.ceil(F.col("n") * percent / 100)
    stats = posted.groupBy("head").agg(F.count("*").alias("s"), F.sum((~F.col("rare")).cast("long")).alias("frequent"), F.first("n").alias("n"))
    stats = stats.where(F.col("s") > _band(smaller)).select("head", "frequent")
    posted = scratch.cut(posted.join(stats, "head"), "posted")
    scratch.free(postings)

    # rare tokens, one by one
    x = posted.where("rare").select("token", F.col("head").alias("a"), F.col("n").alias("na"), F.col("frequent").alias("fa"))
    y = posted.where("rare").select("token", F.col("head").alias("b"), F.col("n").alias("nb"), F.col("frequent").alias("fb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    single = x.join(y, "token").where((F.col("a") < F.col("b")) & fits).groupBy("a", "b").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("na", "nb", "fa", "fb")])
    single = single.where(F.col("c") + F.least("fa", "fb") > _band(F.least("na", "nb"))).select("a", "b", "na")

    # frequent tokens, two of one class together
    bands = F.array_distinct(F.array(_band(F.col("n")), _band(smaller)))
    banded = posted.where("not rare").select("token", "head", "n", "copies", F.explode(bands).alias("m"))
    alone = banded.where("m = 0").select(F.xxhash64("token").alias("sig"), "head", "n", "copies")
    grouped = banded.where("m > 0").groupBy("head", "n", "copies", "m", F.pmod(F.xxhash64("token", "m"), F.col("m")).alias("class")).agg(F.sort_array(F.collect_list("token")).alias("t"))
    two = F.flatten(F.transform("t", lambda t, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda u: F.xxhash64(F.col("m"), t, u))))
    signed = alone.union(grouped.where("size(t) > 1").select(F.explode(two).alias("sig"), "head", "n", "copies"))
    signed = scratch.cut(signed, "signed")
    leaders = signed.groupBy("sig").agg(F.max(F.struct("copies", (-F.col("head")).alias("minus"), "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
    leaders = leaders.select("sig", (-F.col("l.minus")).alias("leader"), F.col("l.n").alias("nl"))
    led = scratch.cut(signed.join(leaders, "sig").select("sig", "head", "n", "leader", "nl"), "led")
    scratch.free(signed)
    star = led.where("head <> leader").where(100 * F.least("n", "nl") >= percent * F.greatest("n", "nl"))
    star = star.select(F.least("head", "leader").alias("a"), F.greatest("head", "leader").alias("b"), F.when(F.col("head") < F.col("leader"), F.col("n")).otherwise(F.col("nl")).alias("na"))
    pairs = scratch.cut(single.union(star).distinct(), "pairs")
    scratch.free(posted)

    wanted = pairs.select(F.col("a").alias("head")).union(pairs.select("b")).union(led.select("head")).distinct()
    sets = scratch.cut(_texts(docs, members, wanted, size, id_col, text_col, count), "sets")
    most = max(PASS_TOKENS, (members.agg(F.sum("n")).first()[0] or 0) // 4)
    passes = _passes(pairs.agg(F.coalesce(F.sum("na"), F.lit(0))).first()[0], most)
    mine = lambda k: pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == k).select("a", "b")
    links = [scratch.cut(_linked(mine(k), sets, percent), "links") for k in range(passes)]
    scratch.free(pairs)
    labels = components(_all(links), scratch)

    # combinations that still join several components: in blocks, then across them
    left = led
    for within in (True, False):
        named = left.join(labels.select(F.col("node").alias("head"), "component"), "head", "left").withColumn("component", F.coalesce("component", "head"))
        open_sigs = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
        named = scratch.cut(named.join(open_sigs, "sig", "left_semi"), "open")
        if not named.limit(1).count():
            break
        left = named.drop("component")
        clusters = components(left.where("head <> leader").select(F.col("head").alias("a"), F.col("leader").alias("b")).distinct(), scratch)
        rows = named.select("head", "n", "component").distinct().join(clusters.select(F.col("node").alias("head"), F.col("component").alias("cluster")), "head")
        rows = scratch.cut(rows, "clusters")
        passes = 1 if within else _passes(_across(rows, percent), most)
        links += [scratch.cut(_in_blocks(rows, sets, percent, within=within, spanning=True, passes=passes, number=k), "links") for k in range(passes)]
        labels = components(_all(links), scratch)
    found = members.join(labels.select(F.col("node").alias("head"), "component"), "head", "left")
    found = scratch.cut(found.select("key", "doc_id", "n", "head", F.coalesce("component", "head").alias("component")), "found")
    scratch.free_all(but=found)
    return found


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, links)


def joined(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the component), key (of the row), component."""
    found = similar_sets(docs, **options)
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key", "component")
