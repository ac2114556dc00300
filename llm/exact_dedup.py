"""Exact dedup by content sort, with DataFrame functions only.

Rows are range-partitioned by a short key of the text (its first characters in lower
case, then a hash for texts that begin alike; equal for equal texts); Spark samples the splitters
from these short keys. Inside a partition an external sort on the whole
normalised text puts equal texts next to each other, and the window compares
neighbours in full, so no hash decides what is equal.

A text with very many copies would fill one range. Texts that make up more than
``1/hot_share`` of the rows (so fewer than ``hot_share`` of them) stay out of the sort:
they are aggregated by their whole text before any shuffle, and the fewer than
``hot_share`` results, without texts, go back to their rows.

Defined results: a null text counts as empty. Of equal texts the row with the
smallest (or largest) id stays; a null id loses to any other; of rows equal in text
and id exactly one stays. Columns of the input other than id and text, whatever
their names, are kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import cut, lower_ascii

def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hot_share: int = 1000) -> DataFrame:
    """One row per input row: its columns inside ``row``, and keep_id, group_size, kept, text_sha256."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    first = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    norm = lower_ascii(text)
    rows = rows.withColumn("_id", F.col("row")[id_col]).withColumn("_hash", F.xxhash64(F.lower(text)))

    total = rows.select(F.count("*").alias("n")).scalar()
    counts = rows.groupBy("_hash").agg(F.count("*").alias("n"))
    hot = F.broadcast(cut(counts.where(F.col("n") * hot_share > total).select("_hash"), "hot"))  # under hot_share rows of one long

    # the sort: short keys choose the range, whole texts decide
    ranged = rows.join(hot, "_hash", "left_anti").withColumn("_head", F.substring(F.lower(F.substring(text, 1, 32)), 1, 32)).repartitionByRange("_head", "_hash").withColumn("_norm", norm)
    run = Window.partitionBy("_head", "_hash", "_norm")
    ordered = run.orderBy(first)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = ranged.select(
        "row",
        F.first("_id").over(whole).alias("keep_id"),
        F.count("*").over(whole).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"),
        F.sha2("_norm", 256).alias("text_sha256"),
    )

    many = rows.join(hot, "_hash", "left_semi").withColumn("_norm", norm)
    merged = many.groupBy("_norm").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
    merged = cut(merged.select(F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size"), "hot-texts")
    many = many.select("row", "_id", F.sha2("_norm", 256).alias("text_sha256")).join(F.broadcast(merged), "text_sha256")
    columns = ["row", "keep_id", "group_size", "kept", "text_sha256"]
    is_best = F.col("_id").eqNullSafe(F.col("keep_id"))
    tied = Window.partitionBy("text_sha256").orderBy("_id")
    tops = many.where(is_best).withColumn("kept", F.row_number().over(tied) == 1).select(*columns)
    rest = many.where(~is_best).withColumn("kept", F.lit(False)).select(*columns)
    return sorted_rows.unionByName(tops).unionByName(rest)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    return mark_duplicates(docs, **options).where("kept").select("row.*")
