"""Best-fit packing of token pieces into sequences by sums of squares.

A document longer than a sequence is cut into full pieces and a last shorter one;
no other document is cut. Pieces are dealt evenly into groups of bounded size, and
each group is packed on its own: every piece goes where the sum, over all gaps, of
the squared number of open sequences with that gap becomes smallest. Pieces come
longest first. The longer ones may open a sequence although others would take them,
which keeps a mix of gaps; the shortest quarter then fills the gaps and opens a
sequence only if nothing fits. Where many pieces are too long to share a sequence, it is
better if all pieces do so; a group is packed in both ways and keeps the one with fewer
sequences. A group ends with a sequence or two that are not full.

Defined results: a null text counts as empty and is one piece with the end id only.
Equal rows are placed each on their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut

#: Bytes of text that a worker encodes at once: few, as in a pipeline it starts beside what earlier stages left in memory.
SLICE_BYTES = 2_000_000
PIECES = "doc_id {id}, piece int, start bigint, length int, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of documents: doc_id, piece, start, length, ids_crc32; cut in the worker that tokenises."""

    def run(batches):
        import zlib

        import pyarrow as pa

        from llm.token_rows import encoded, ended

        for doc_ids, flat, bounds in encoded(batches, tokenizer, SLICE_BYTES):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(ended(flat, bounds, end_id)):
                for k, begin in enumerate(range(0, len(ids) // 4, size)):
                    part = ids[4 * begin : 4 * (begin + size)]
                    at.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [doc_ids.take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES.format(id=kind))


def sums_of_squares(lengths, size: int, fill: float):
    """Sequence number and offset for each of ``lengths``, which are sorted, longest first; the last share ``fill`` only fills up."""
    import numpy as np

    count = np.zeros(size + 1, dtype=np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, used = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    filling = int(len(lengths) * (1 - fill))
    none = 1 << 60
    for i, s in enumerate(lengths.tolist()):
        gap, best = size, none
        if s < size:
            now = count[s:size]  # what leaving gap g and entering gap g - s does to the sum
            change = 2 * (count[: size - s] - now) + 2
            change[0] = 1 - 2 * now[0]
            change[now == 0] = none
            k = int(change.argmin())
            best = int(change[k])
            if best < none and (i >= filling or best <= 2 * int(count[size - s]) + 1):
                gap = s + k
        if gap == size:
            number = used
            used += 1
        else:
            number = open_by_gap[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = number, size - gap
        if gap > s:
            open_by_gap[gap - s].append(number)
            count[gap - s] += 1
    return sequence, offset


def pack(rows: DataFrame, size: int, most_in_group: int = 200_000) -> DataFrame:
    """Add sequence_id and offset to ``pieces``; ``rows`` is a written table, read more than once."""
    n = rows.count()
    groups = max(1, -(-n // most_in_group))
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        group = table.column("_group")[0].as_py()
        lengths = table.column("length").to_numpy().astype(np.int64)
        sequence, offset = min((sums_of_squares(lengths, size, fill) for fill in (0.25, 1.0)), key=lambda x: x[0].max())
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array(sequence + (group << 40))).append_column("offset", pa.array(offset))

    # rows are dealt by their place in the written table, so that equal rows spread too
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places."""
    rows = cut(pieces(docs, tokenizer, end_id, size, id_col, text_col), "pieces")
    return pack(rows, size)


def sequences(tokens: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32 bits), document starts."""
    parts = packed.join(tokens, "doc_id").select(
        "sequence_id", "offset", F.substring("ids", (4 * F.col("start") + 1).cast("int"), 4 * F.col("length")).alias("part")
    )
    placed = F.array_sort(F.collect_list(F.struct("offset", "part")))  # at most ``size`` pieces
    return parts.groupBy("sequence_id").agg(placed.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("ids"), F.col("p.offset").alias("starts")
    )
