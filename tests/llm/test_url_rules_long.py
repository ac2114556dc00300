import itertools

from pyspark.sql import functions as F

from llm import url_rules


def test_a_rule_of_four_tokens_is_found(spark):
    """Only the host with all three segments is reliable; each of its parts has more good pages than bad ones."""
    urls = [(f"http://big.org/a/b/c/{i}", 0) for i in range(30)]
    for two in itertools.combinations("abc", 2):
        urls += [(f"http://big.org/{'/'.join(two)}/{i}", 1) for i in range(40)]
    urls += [(f"http://{h}.net/a/b/c/{i}", 1) for h in ("x1", "x2") for i in range(20)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(urls)], "doc_id bigint, quality int")
    known = pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("tokens"))
    mined = url_rules.mine(known, labels.withColumnRenamed("doc_id", "label_id"), "page_id", F.col("quality") == 0).collect()
    assert mined and all(len(r.tokens) == 4 and {"p:a", "p:b", "p:c"} < set(r.tokens) and r.confidence == 1 for r in mined)
    got = url_rules.judged(pages, labels, F.col("quality") == 0, [("allow", "none.org", "/")]).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(30))
