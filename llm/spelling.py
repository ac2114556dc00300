"""Spelling variants by PartEnum signatures over letter multisets.

Words that differ by one inserted, deleted or replaced code point have letter multisets
that differ in at most two letters. A multiset is a binary vector: the second ``e`` of a word is a
dimension of its own. The dimensions are dealt into parts; vectors at a Hamming distance of at most two differ in at
most two parts, so they agree in all others, and for each choice of two parts the contents of the others are
one exact signature. Words with the same letters are one class, and only classes are signed and joined, so
anagrams, which are never near each other, make no pairs.

Classes that share a signature are verified with their words: the letter that one class has and the other
hasn't says which words to look for, so that a pair of classes costs as much as they have words. Classes
with many words are cut into chunks. No list of all pairs of a group is made; only near words are.
Tables that grow with the words are joined by sorting: Spark takes the signatures, exploded from a small compressed file, for a small table and would broadcast them.

Defined results: a null or empty text has no words, a null id counts as an empty text in ``damaged``; equal rows are read as often as they
occur. A word without near words has none and is its own root. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import LOWER, UPPER, cut, ship

#: Parts of the dimensions: two of them are left out of each signature, so 28 signatures a class.
PARTS = 8
#: Words of a class that are verified at once.
CHUNK = 512


def counted(docs: DataFrame, least_letters: int = 7, damage: int | None = 31, id_col: str = "doc_id", text_col: str = "text", most_held: int = 300_000) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z lower-cased, with at least ``least_letters`` code points.

    With ``damage``, a run loses the code point h % length where ``damage`` divides h, the crc32 of ``<id>:<run>``.
    Counts are held by task up to a bound and summed.
    """
    ship(docs.sparkSession)
    lower = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))

    def run(batches):
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        from llm.common import utf8_bytes
        from llm.tokens import in_batches

        runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_letters).findall
        held: Counter = Counter()

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for a, b in in_batches(batch.column(1)):
                for i, text in zip(batch.column(0).slice(a, b - a).to_pylist(), utf8_bytes(batch.column(1).slice(a, b - a)), strict=True):
                    found = runs(text.translate(lower).decode())
                    if damage is None:
                        held.update(found)
                        continue
                    start = crc32(f"{i}:".encode())
                    for word, n in Counter(found).items():
                        h = crc32(word.encode(), start)
                        if h % damage == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least_letters:
                                continue
                        held[word] += n
                if len(held) > most_held:
                    yield table()
                    held.clear()
        if held:
            yield table()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def part_hashes(key: str, parts: int = PARTS) -> list[int]:
    """For each part a 64-bit hash of the dimensions that a word with these sorted letters has in it."""
    from zlib import crc32

    from xxhash import xxh3_64_intdigest as digest

    out, times, last = [0] * parts, 0, None
    for letter in key:
        times = times + 1 if letter == last else 0
        last = letter
        dimension = f"{letter}{times}".encode()
        out[crc32(dimension) % parts] ^= digest(dimension)
    return [h - (1 << 64) if h >> 63 else h for h in out]


def _classes(words: DataFrame, parts: int) -> DataFrame:
    """(key, length, chunks, hashes) of each multiset of letters."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hashes = [part_hashes(k, parts) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.list_(pa.int64()))], names=["key", "length", "chunks", "hashes"])

    classes = words.groupBy("key").agg(F.length("key").alias("length"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    return classes.mapInArrow(run, "key string, length int, chunks int, hashes array<bigint>")


def signatures(hashes: Column, parts: int = PARTS) -> Column:
    """For each two parts the hash of what all others hold."""
    every = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda x, h: x.bitwiseXOR(h))
    both = [(i, j) for i in range(parts) for j in range(i + 1, parts)]
    return F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in both]), lambda p: F.xxhash64(p["i"], p["j"], every.bitwiseXOR(hashes[p["i"]]).bitwiseXOR(hashes[p["j"]])))


def differing(a: str, b: str) -> tuple[str, str] | None:
    """What sorted letters ``a`` have beyond ``b`` and ``b`` beyond ``a``, at most one letter each; None if there is more."""
    i = j = 0
    x = y = ""
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            if x:
                return None
            x, i = a[i], i + 1
        else:
            if y:
                return None
            y, j = b[j], j + 1
    x, y = x + a[i:], y + b[j:]
    return (x, y) if len(x) < 2 and len(y) < 2 else None


def near_words(left: list[str], right: list[str], x: str, y: str):
    """Pairs (place in left, place in right) of words one edit apart: ``left`` have ``x`` (or nothing), ``right`` have ``y`` instead."""
    if not x:  # the right words have one letter more: look from them
        return [(p, q) for q, p in near_words(right, left, y, x)]
    place = {w: k for k, w in enumerate(right)}
    found = []
    for p, w in enumerate(left):
        at, seen = w.find(x), set()
        while at >= 0:
            q = place.get(w[:at] + y + w[at + 1 :])
            if q is not None and q not in seen:
                seen.add(q)
                found.append((p, q))
            at = w.find(x, at + 1)
    return found


def near(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, near, near_n) in both directions for all words one edit apart. ``words``: a written table (word, n)."""
    keyed = words.select("word", "n", F.array_join(F.array_sort(F.split("word", "")), "").alias("key"))
    classes = cut(_classes(keyed, parts), "classes").withColumn("id", F.monotonically_increasing_id())
    ids = cut(classes, "class-ids")
    signed = ids.select("id", "length", F.explode(signatures(F.col("hashes"), parts)).alias("sig"))
    a, b = signed.select("sig", F.col("id").alias("a"), F.col("length").alias("la")), signed.select("sig", F.col("id").alias("b"), F.col("length").alias("lb"))
    pairs = a.join(b.hint("merge"), "sig").where((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= 1)).select("a", "b").distinct()

    # the words of a class, chunk by chunk, as one text: word, n, word, n, ...
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks"))
    spelt = keyed.join(ids.select("key", "id", "chunks").hint("merge"), "key").groupBy("id", chunk.alias("chunk")).agg(F.array_join(F.collect_list(F.concat_ws(" ", "word", "n")), " ").alias("words"))
    chunks = cut(spelt.select("id", "words"), "chunks")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, two = one.split(" "), two.split(" ")
                apart = differing("".join(sorted(one[0])), "".join(sorted(two[0])))
                if apart and apart != ("", ""):
                    for p, q in near_words(one[::2], two[::2], *apart):
                        for s, t, i, j in ((one, two, 2 * p, 2 * q), (two, one, 2 * q, 2 * p)):
                            for column, value in zip(out, (s[i], int(s[i + 1]), t[j], int(t[j + 1])), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "near", "near_n"])

    first = chunks.select(F.col("id").alias("a"), F.col("words").alias("one"))
    second = chunks.select(F.col("id").alias("b"), F.col("words").alias("two"))
    return pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("one", "two").mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def roots(words: DataFrame) -> DataFrame:
    """(word, root): where forms lead from the words that have one. Each round doubles how far a word sees; forms grow in number, so there are few."""
    step = cut(words.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(step.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return step


def variants(words: DataFrame, times: int = 10, parts: int = PARTS) -> DataFrame:
    """word, n, n_near, form, form_n, root for words (word, n), each distinct.

    A word's form is its near word of the largest n (then the first in code-point order), if that has at least ``times`` its own n;
    its root is where forms lead from it.
    """
    words = cut(words, "words")
    best = near(words, parts).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    formed = F.when(-F.col("best.minus") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n")))
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), formed.alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"), "variants")
    return found.join(roots(found).hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
