"""Token ids of documents as a table: shared by packing and by the token files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of text that a worker encodes at once (one text may be longer).
SLICE_BYTES = 8_000_000


def encoded(batches, path: str, most_bytes: int = SLICE_BYTES):
    """Of Arrow batches (id, text), slice by slice: the ids of documents, their token ids one after the other, and each document's bounds in these.

    Slices are bounded in bytes of text, and a worker's memory grows with them; what is done with token ids is done here, in the one Python worker
    that makes them, and never sent through a second one.
    """
    import pyarrow as pa

    from llm.tokens import encoder, in_batches

    known = encoder(path)
    for batch in batches:
        texts = batch.column(1)
        for a, b in in_batches(texts, most_bytes):
            yield batch.column(0).slice(a, b - a), *known.encode(texts.slice(a, b - a))
        pa.default_memory_pool().release_unused()


def ended(ids, bounds, end_id: int, kind: str = "<u4") -> list[bytes]:
    """The ids of each document and ``end_id``, as little-endian bytes of this kind."""
    import numpy as np

    end, data = np.array([end_id], dtype=kind).tobytes(), ids.astype(kind).tobytes()
    cuts = (bounds * np.dtype(kind).itemsize).tolist()
    return [data[a:b] + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bits, ``end_id`` last); a null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for doc_ids, ids, bounds in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ended(ids, bounds, end_id), pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")
