"""Token files: ids in the order of documents, in blocks of a static rANS coder.

``write`` range-partitions the tokenised documents by id, sorts each range and
writes blocks of whole documents: one row a block, in Parquet as the container, with
the range and block numbers, the documents' ids and lengths, and the coded ids. All
blocks share one table of frequencies, counted over all ids and stored beside them.
A block needs nothing but that table, so any task can decode any block, or from any
checkpoint inside. ``read`` decodes blocks and returns the documents.

Defined results: a null text counts as empty, so its document has the end id only; a
null id comes first; equal ids follow each other in any order. A document is never
split over blocks. An empty table gives files without blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut


def _counted(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Token ids in 16 bits where they all fit (the first byte tells), and after them one row a task with its counts of ids.

    Columns: doc_id, n, ids; seen and times, only in the rows of counts, whose n is null.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from llm.token_rows import encoded, ended

        total, kind = np.zeros(end_id + 1, dtype=np.int64), None

        def rows(doc_ids, n, ids, seen, times):
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (seen, times)]
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int32()), pa.array(ids, pa.binary()), *lists], names=["doc_id", "n", "ids", "seen", "times"])

        for doc_ids, ids, bounds in encoded(batches, tokenizer):
            kind, count = doc_ids.type, len(bounds) - 1
            seen = np.bincount(ids, minlength=len(total))
            seen[: len(total)] += total
            seen[end_id] += count
            total = seen
            narrow = end_id < 1 << 16 and (not len(ids) or int(ids.max()) < 1 << 16)
            tag, width = (b"\2", "<u2") if narrow else (b"\4", "<u4")
            none = [None] * count
            yield rows(doc_ids, np.diff(bounds) + 1, [tag + x for x in ended(ids, bounds, end_id, width)], none, none)
        if kind is not None:
            some = np.flatnonzero(total)
            yield rows(pa.nulls(1, kind), [None], [None], [some], [total[some]])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n int, ids binary, seen array<bigint>, times array<bigint>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 18, range_ids: int = 1 << 22
) -> None:
    """Tokenise ``docs`` and write the files below ``path``."""
    spark = docs.sparkSession
    counted = cut(_counted(docs, tokenizer, end_id, id_col, text_col), "ids")
    each = counted.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("c"))
    each.groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.times").alias("n")).write.parquet(f"{path}/table")
    tokens = counted.where("n is not null").select("doc_id", "n", "ids")
    freq = _table(spark, path)
    total = tokens.agg(F.sum("n")).first()[0] or 0

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from llm.rans import Coder

        coder, number, before = Coder(freq), 0, 0
        ids, lengths, parts, held = [], [], [], 0

        def flush():
            nonlocal number, before, ids, lengths, parts, held
            block = coder.encode(np.concatenate(parts))
            row = {"range_no": [TaskContext.get().partitionId()], "block_no": [number], "ids_before": [before], "n_ids": [held], "doc_ids": pa.array([ids], pa.list_(kind)), "lengths": pa.array([lengths], pa.list_(pa.int32())), "block": pa.array([block], pa.binary())}
            number, before = number + 1, before + held
            ids, lengths, parts, held = [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            kind = batch.column(0).type
            for i, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                lengths.append(n)
                parts.append(np.frombuffer(data, f"<u{data[0]}", offset=1))
                held += n
                if held >= block_ids:
                    yield flush()
        if ids:
            yield flush()

    kind = tokens.schema["doc_id"].dataType.simpleString()
    ranges = tokens.repartitionByRange(max(1, -(-total // range_ids)), "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    schema = f"range_no bigint, block_no bigint, ids_before bigint, n_ids bigint, doc_ids array<{kind}>, lengths array<int>, block binary"
    ranges.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _table(spark: SparkSession, path: str):
    """The shared frequencies; no longer than the vocabulary."""
    import numpy as np

    from llm.rans import frequencies

    rows = spark.read.schema("id bigint, n bigint").parquet(f"{path}/table").collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    return frequencies(counts)


def read(spark: SparkSession, path: str, what: dict[str, Column] | None = None) -> DataFrame:
    """Every document in the files: doc_id, start, n_tokens, ids (little-endian unsigned 32 bits).

    Instead of the ids, ``what`` may name expressions over them, computed where blocks are
    decoded: then the ids themselves aren't shuffled.
    """
    freq = _table(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from llm.rans import Coder

        coder = Coder(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("range_no", "ids_before", "lengths", "block")}
                ids = coder.decode(row["block"].as_py())
                lengths = np.array(row["lengths"].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                data = ids.astype("<u4").tobytes()
                starts = ends - lengths
                each = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([row["range_no"].as_py()] * len(each), pa.int64()), batch.column("doc_ids")[k].values, pa.array(starts + row["ids_before"].as_py()), pa.array(lengths), pa.array(each, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["range_no", "doc_id", "in_range", "n_tokens", "ids"])

    docs = blocks.mapInArrow(run, f"range_no bigint, doc_id {kind}, in_range bigint, n_tokens bigint, ids binary")
    # one row a range; the ranges follow each other in the order of ids
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("range_no").agg(F.sum("n_ids").alias("n")).select("range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    found = {"ids": F.col("ids")} if what is None else what
    docs = docs.select("range_no", "doc_id", "in_range", "n_tokens", *[c.alias(name) for name, c in found.items()])
    return docs.join(ranges, "range_no").select("doc_id", (F.col("base") + F.col("in_range")).alias("start"), "n_tokens", *found)
