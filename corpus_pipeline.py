"""A corpus pipeline: toxicity, exact dedup, near duplicates, mixing, packing.

Every stage takes the documents that its predecessor kept, as written Parquet, and all but the
last return documents with the columns they came with. Nulls, empty texts, repeated
rows and empty tables have the results that the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.session import scratch_path
from llm import exact_dedup, ngram_join, packing, toxicity
from llm.common import remainder, table
from llm.queries import mixed, tokenizer_path

#: Documents that score at least this are rejected.
TOXIC = 0.7


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from this folder's labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, use=remainder("doc_id", 3) != 1)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("text"))
    return model.score(rows).where(F.col("score") < TOXIC).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased) the one with the largest id."""
    return exact_dedup.deduplicated(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8 the document with the smallest id.

    Rows are told apart by id and text; of rows equal in both one stays. A null id comes last.
    """
    own = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text"))
    rows = docs.select(own.alias("_own"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    sets = ngram_join.similar_sets(docs.select(own.alias("_own"), docs["text"].alias("text")), size=5, percent=80, id_col="_own")
    kept = sets.groupBy("component").agg(F.min("doc_id").alias("_own")).select("_own")
    return rows.join(kept, "_own", "left_semi").dropDuplicates(["_own"]).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of sources, languages and topics."""
    return mixed(docs).where("selected").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents and their places in sequences of 2048 tokens."""
    return packing.packed_documents(docs, tokenizer_path(), end_id=0, size=2048)


STAGES = [("toxicity", not_toxic), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("packing", pack)]

#: The boosted trees of the first stage have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
