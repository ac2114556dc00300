"""Benchmark decontamination by suffix arrays of the training text.

Training documents are read in shards of bounded size. A shard's words become numbers, all
words that no test item has being one breaker, and its suffix array holds every place whose
word some item has, sorted by what follows it as far as the longest item reaches. Every
suffix of every test item is then looked up in each shard by binary search, which gives the
places where its first words (a window) occur. Places of an item's suffixes
that follow each other are one verbatim match: so each match has its full length and its places in
item and document. A document's words inside any match are hit, and documents with a hit are affected.

Items are searched as a stated set, in blocks of bounded size, against all documents; a
block is sent to the tasks as a broadcast, whose size is thus bounded whatever the benchmark's (only an item longer than
a block is a block of its own). With several blocks the documents are numbered in a written table and the blocks' results combined.

Words are maximal runs of 0-9, a-z and all characters from U+0080 on, after lower-casing A-Z.

Defined results: a null text has no words; an item without words is never found, one with
fewer words than a window is found as a whole only. Equal documents are marked each on their own. Items with the same
id count as one, an item with a null id has the empty id. Empty tables give documents without hits, or no documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import cut

WINDOW = 10
#: Bytes of documents in a shard (one text may be longer), and of items in a block.
SHARD_BYTES, BLOCK_BYTES = 6_000_000, 16_000_000
#: Bytes outside words become a space; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Items:
    """Test items as numbers: what a block sends to the tasks."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        import numpy as np

        vocabulary: dict[bytes, int] = {}
        texts = [(i, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)]) for i, t in items]
        texts = [(i, t) for i, t in texts if t]
        self.ids, self.vocabulary, self.window = [i for i, _ in texts], vocabulary, window
        self.longest = max((len(t) for _, t in texts), default=0)
        #: How many words a 63-bit number holds.
        self.bits = max(1, len(vocabulary).bit_length())
        self.packed = max(1, min(63 // self.bits, 10))
        length = np.array([len(t) for _, t in texts], dtype=np.int64)
        self.words = np.concatenate([np.array([*t, 0], dtype=np.int64) for _, t in texts]) if texts else np.zeros(0, dtype=np.int64)
        start = np.cumsum(length + 1) - length - 1
        # one query for each window: its item, its place in the item, its words
        wide = np.minimum(length, window)
        count = length - wide + 1
        self.item = np.repeat(np.arange(len(texts)), count)
        self.at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.place, self.width = start[self.item] + self.at, wide[self.item]


def _packed(words, packed: int, bits: int):
    """At each place the next ``packed`` words as one number; nothing follows a breaker."""
    import numpy as np

    out, alive = words.astype(np.int64).copy(), words > 0
    for k in range(1, packed):
        following = np.zeros(len(words), dtype=np.int64)
        following[: len(words) - k] = words[k:]
        alive &= following > 0
        out = (out << bits) | np.where(alive, following, 0)
    return out


def suffix_array(words, longest: int, packed: int, bits: int):
    """Places of ``words`` (0: a breaker) that aren't breakers, sorted by their next ``longest`` words, and their packed words."""
    import numpy as np

    keys = _packed(words, packed, bits)
    places = np.flatnonzero(words > 0)
    own = keys[places]
    sort = np.argsort(own, kind="stable")
    array, own = places[sort], own[sort]
    new = np.ones(len(array), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    rank = np.zeros(len(words) + 1, dtype=np.int64)  # of a place: 1 + where its group of equals begins; 0 after a breaker
    begin = np.maximum.accumulate(np.where(new, np.arange(len(array)), 0))
    rank[array] = begin + 1
    known = packed
    # only what is still tied is sorted again, by the rank of what follows: twice the words known
    while known < longest:
        tied = np.zeros(len(array), dtype=bool)
        tied[1:] = ~new[1:]
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        place = array[tied]
        # what ended at a breaker is tied for good
        follow = rank[np.minimum(place + known, len(words))]
        group = rank[place]
        sort = np.lexsort((follow, group))
        array[tied], follow, group = place[sort], follow[sort], group[sort]
        apart = np.ones(len(tied), dtype=bool)
        apart[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        if not (apart & ~new[tied]).any():
            if not follow.any():
                break
        new[tied] = apart
        begin = np.maximum.accumulate(np.where(new, np.arange(len(array)), 0))
        rank[array[tied]] = begin[tied] + 1
        known *= 2
    return array, keys


def search(array, keys, queries, widths, packed: int, bits: int):
    """Binary search of every query at once: where, in the suffix array, the suffixes with its first ``widths`` words begin and end.

    ``queries``: the packed words at each query's place and every ``packed`` places further.
    """
    import numpy as np

    n = len(queries[0])
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(array), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            order = np.zeros(len(open_), dtype=np.int8)  # of the suffix against the query, in the first words
            undecided, place = np.arange(len(open_)), array[middle]
            for k, query in enumerate(queries):
                left = widths[open_[undecided]] - k * packed
                undecided = undecided[left > 0]
                if not len(undecided):
                    break
                cutoff = (bits * np.maximum(packed - left[left > 0], 0)).astype(np.int64)
                at = place[undecided] + k * packed
                mine = np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], 0) >> cutoff
                theirs = query[open_[undecided]] >> cutoff
                order[undecided] = np.sign(mine - theirs)
                undecided = undecided[mine == theirs]
            right = order <= 0 if upper else order < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        bounds.append(low)
    return bounds


class Searcher:
    """Finds a block's items in shards."""

    def __init__(self, items: Items):
        import numpy as np

        self.items, p, b = items, items.packed, items.bits
        keys = _packed(items.words, p, b) if len(items.words) else items.words
        self.queries = []
        for k in range(0, max(items.window, 1), p):
            at = items.place + k
            self.queries.append(np.where(at < len(keys), keys[np.minimum(at, max(len(keys) - 1, 0))], 0) if len(keys) else items.place)

    def matches(self, texts: list[list[bytes]]):
        """Maximal verbatim matches in documents of words: (document, item, place in document, place in item, length), and each document's hit spans."""
        import numpy as np

        none = np.zeros(0, dtype=np.int64)
        items, known = self.items, self.items.vocabulary.get
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = np.fromiter((known(w, 0) for t in texts for w in (*t, b"")), dtype=np.int64, count=int(length.sum()) + len(texts))
        start = np.cumsum(length + 1) - length - 1
        if not len(items.item) or not (flat > 0).any():
            return none, none, none, none, none
        array, keys = suffix_array(flat, items.longest, items.packed, items.bits)
        # of queries whose first packed words occur nowhere, the others can't
        first = np.minimum(items.width, items.packed)
        shift = items.bits * (items.packed - first)
        head = keys[array]
        low = np.searchsorted(head, (self.queries[0] >> shift) << shift, side="left")
        high = np.searchsorted(head, ((self.queries[0] >> shift) + 1) << shift, side="left")
        some = np.flatnonzero(low < high)
        low, high = search(array, keys, [q[some] for q in self.queries], items.width[some], items.packed, items.bits)
        times = high - low
        query = np.repeat(some, times)
        where = array[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
        # places that follow each other in item and document are one match
        item, at = items.item[query], items.at[query]
        sort = np.lexsort((where, where - at, item))
        item, at, where, width = item[sort], at[sort], where[sort], items.width[query][sort]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (where[1:] - at[1:] != where[:-1] - at[:-1]) | (where[1:] != where[:-1] + 1)
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(item)))
        doc = np.searchsorted(start, where[begin], side="right") - 1
        return doc, item[begin], where[begin] - start[doc], at[begin], run - 1 + width[begin]


def _spans(doc, place, length, documents: int):
    """For each document the union of its spans, as (start, length) pairs."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(documents)]
    for d, a, n in sorted(zip(doc.tolist(), place.tolist(), length.tolist(), strict=True)):
        own = out[d]
        if own and a <= own[-1][0] + own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], a + n - own[-1][0]))
        else:
            own.append((a, n))
    return out


SPANS = "array<struct<start:int,length:int>>"


def _search(docs: DataFrame, block, text_col: str) -> DataFrame:
    """``docs`` (row, text) against one broadcast block: row, n_words, spans, matches."""
    kind = docs.schema["row"].dataType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from llm.common import utf8_bytes
        from llm.tokens import in_batches

        items = block.value
        searcher = Searcher(items)
        longest = pa.struct([("item_id", pa.string()), ("length", pa.int32()), ("item_start", pa.int32()), ("start", pa.int32())])
        span = pa.struct([("start", pa.int32()), ("length", pa.int32())])

        def shard(rows, texts):
            lists = [words_of(t) for t in texts]
            doc, item, place, at, length = searcher.matches(lists)
            spans = _spans(doc, place, length, len(lists))
            best: list[dict] = [{} for _ in lists]  # of each item in a document the longest match, then the first
            sort = np.lexsort((at, place, -length))
            for d, i, n, a, p in zip(*[x[sort].tolist() for x in (doc, item, length, at, place)], strict=True):
                best[d].setdefault(items.ids[i], (n, a, p))
            matches = [[{"item_id": i, "length": n, "item_start": a, "start": p} for i, (n, a, p) in sorted(b.items())] for b in best]
            spans = [[{"start": a, "length": n} for a, n in s] for s in spans]
            columns = [rows, pa.array([len(x) for x in lists], pa.int64()), pa.array(spans, pa.list_(span)), pa.array(matches, pa.list_(longest))]
            return pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "spans", "matches"])

        held, texts, size = [], [], 0
        for batch in batches:
            for a, b in in_batches(batch.column(1), SHARD_BYTES // 2):
                held.append(batch.column(0).slice(a, b - a))
                texts += (own := utf8_bytes(batch.column(1).slice(a, b - a)))
                size += sum(map(len, own))
                if size >= SHARD_BYTES // 2:
                    yield shard(pa.concat_arrays(held), texts)
                    held, texts, size = [], [], 0
        if held:
            yield shard(pa.concat_arrays(held), texts)

    from pyspark.sql import types as T

    schema = T.StructType().add("row", kind)
    for field in T.StructType.fromDDL(f"n_words bigint, spans {SPANS}, matches array<struct<item_id:string,length:int,item_start:int,start:int>>"):
        schema.add(field)
    return docs.select("row", F.col(text_col).alias("text")).mapInArrow(run, schema)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items, block by block, as lists of (id as text, text in UTF-8); a block is read when it is asked for."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else rows
        yield count, [(r.id, bytes(r.text)) for r in own.collect()]  # about block_bytes


def matched(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: row (its columns), n_words, spans (its hit words: start and length), matches.

    ``matches``: for each item that occurs, in the order of ids as text, the longest verbatim match and its place in item and document.
    """
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    for count, block in _blocks(items, id_col, text_col, block_bytes):
        if count > 1 and not parts:  # several blocks: numbers tell equal rows apart
            rows = cut(rows.select(F.struct(F.monotonically_increasing_id().alias("number"), "row").alias("row"), "text"), "numbered")
        found = _search(rows, spark.sparkContext.broadcast(Items(block, window)), "text")
        if count == 1:
            return found
        parts.append(cut(found, "matched"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    both = every.groupBy(F.col("row.number").alias("number")).agg(  # one row a block and document
        F.first("row.row").alias("row"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"),
    )
    return both.select("row", "n_words", _union(F.col("spans")).alias("spans"), _longest(F.col("matches")).alias("matches"))


def _union(spans: Column) -> Column:
    """Sorted spans, overlapping and touching ones joined."""

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        end = F.greatest(last["start"] + last["length"], x["start"] + x["length"])
        grown = F.struct(last["start"].alias("start"), (end - last["start"]).alias("length"))
        joins = (F.size(out) > 0) & (x["start"] <= last["start"] + last["length"])
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(spans, F.expr(f"cast(array() as {SPANS})"), step)


def _longest(matches: Column) -> Column:
    """Of the matches of one id, which several blocks may hold, the longest, then the first."""
    ids = F.array_distinct(F.transform(matches, lambda m: m["item_id"]))
    key = lambda m: F.struct((-m["length"]).alias("minus"), m["start"].alias("start"), m["item_start"].alias("item_start"))

    def best(i: Column) -> Column:
        least = F.array_min(F.transform(F.filter(matches, lambda m: m["item_id"] == i), key))
        return F.struct(i.alias("item_id"), (-least["minus"]).alias("length"), least["item_start"].alias("item_start"), least["start"].alias("start"))

    return F.transform(ids, best)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["length"])


def decontaminated(docs: DataFrame, items: DataFrame, most_hit: int = 0, **options) -> DataFrame:
    """The documents, with their own columns, of which at most ``most_hit`` words are hit."""
    found = matched(docs, items, **options)
    return found.where(hit_words(F.col("spans")) <= most_hit).select("row.*")
