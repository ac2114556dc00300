import time

from pyspark.sql import functions as F

from llm import url_rules


def test_thirty_shared_segments_are_one_item(spark):
    """Pages below one long path: its segments always come together, so they don't multiply."""
    path = "/".join(f"seg{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30))
    urls = [(f"http://bad.org/{path}/{i}", 0) for i in range(30)] + [(f"http://good{i % 7}.org/news/{i}", 1) for i in range(100)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(999, "http://elsewhere.net/segaa/x"), (1000, "http://www.bad.org/other")], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(urls)], "doc_id bigint, quality int")
    began = time.time()
    known = pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("tokens"))
    (rule,) = url_rules.mine(known, labels.withColumnRenamed("doc_id", "label_id"), "page_id", F.col("quality") == 0).collect()
    assert len(rule.tokens) == 1 and {"h:bad", "d:bad.org", "p:segaa", "p:segbd"} <= set(rule.alike[0]) and rule.confidence == 1 and rule.pages == 30
    got = url_rules.judged(pages, labels, F.col("quality") == 0, [("allow", "none.org", "/")]).collect()
    # each token of the group stands for it, as each would have been a rule of its own
    assert {r.page_id for r in got if r.verdict == "block"} == {*range(30), 999, 1000}
    assert time.time() - began < 60
