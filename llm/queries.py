"""The thin queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.session import scratch_path
from llm import conversation_repair, exact_dedup, lm_score, mixing, ngram_join, packing, spelling, suffix_match, syncmers, token_files, toxicity, twins, url_rules, warc
from llm.common import remainder, table
from llm.registry import query

#: A file of the public tokenizers; read where tasks run.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op1_lm_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.byte_score(table(spark, sf_dir, "documents"), train=remainder("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op2_exact_dedup",
    """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = exact_dedup.mark_duplicates(docs, keep="largest")
    return marked.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: The token budget of the mixture, as a share of the tokens it is drawn from.
MIXED_SHARE = 0.5


def mixed(docs: DataFrame) -> DataFrame:
    """Documents with their probabilities for tempered shares of sources, languages and topics, within the token budget."""
    text = F.coalesce(docs["text"], F.lit(""))
    return mixing.sampled(docs, {"source": docs["source"], "lang": docs["lang"], "topic": mixing.topic(text)}, budget=MIXED_SHARE)


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", "factor", "probability", "selected")


@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages")), keep=["page_id"])
    field = lambda name: F.col("headers")[name]
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"),
        field("WARC-Block-Digest").alias("block_digest"), F.octet_length("block").cast("long").alias("length"),
        F.sha2(warc.serialised(F.col("headers"), F.col("block")), 256).alias("record_sha256"),
    )


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learnt from the labels of this folder, but for those whose remainder is 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(table(spark, sf_dir, "documents"), labels, use=remainder("doc_id", 3) != 1)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_model(spark, sf_dir).score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, size=2048)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


#: The given rules of the contract: action, host, start of the path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op7_url_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    found = url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), labels, bad, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "mined")


@query("op8_syncmers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.with_neighbours(table(spark, sf_dir, "documents"))


@query("op9_ngram_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_files.read(spark, path, {"ids_crc32": F.crc32("ids")})


@query("op11_spelling", twins.SPELLING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(spelling.counted(table(spark, sf_dir, "documents")).where("n >= 2"), times=10)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_suffix_match", twins.SUFFIX_MATCH)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_match.matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hit, items = suffix_match.hit_words(F.col("spans")), F.array_join("matches.item_id", ",")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op13_conversation_repair", twins.CONVERSATION_REPAIR)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    hashed = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary"))
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"), lambda c: conversation_repair.damaged(c, hashed))
