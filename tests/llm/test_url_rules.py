import random

from pyspark.sql import functions as F

from llm import url_rules
from llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "://x", "https://WWW.Example.COM/en/1", "http://a.www.example.com/en/", "http://example.com/EN/", "http://example.com/en/x?y#z",
    "http://example.com", "http://example.com?/en/", "http://notexample.com/en/1", "ftp://b.net/es/", "http://net/fr/a", "http://x.net/fr#/es/", "http://a.net/en/http://b/",
    "http://com/", "http://x.org/en/", "http://.com/", "http://example.com/en/x\ny",
]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, "allow"))


def test_given_rules_by_brute_force(spark):
    urls = URLS + URLS[:4]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages, labels, F.col("quality") == 0, URL_RULES).collect()}
    assert got == {i: expected(u) for i, u in enumerate(urls)}
    assert url_rules.judged(pages.limit(0), labels, F.col("quality") == 0, URL_RULES).count() == 0


def test_mined_rules_by_brute_force(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        farm, sale = rng.random() < 0.3, rng.random() < 0.3
        host = "farm.org" if farm else rng.choice(["a.org", "b.org"])
        rows.append((i, f"http://{host}/{'sale' if sale else rng.choice(['x', 'y'])}/{i}"))
        bad = farm and sale if rng.random() < 0.95 else rng.random() < 0.1
        labels.append((i, int(not bad)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    known = pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("tokens"))
    mined = url_rules.mine(known, labels.withColumnRenamed("doc_id", "label_id"), "page_id", F.col("quality") == 0, support=15, confidence=0.7).collect()
    sets = {r.page_id: set(r.tokens) for r in known.collect()}
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert mined
    for r in mined:
        fit = [i for i, s in sets.items() if set(r.tokens) <= s]
        assert abs(r.confidence - sum(i in bad for i in fit) / len(fit)) < 1e-9 and r.pages >= 15
        assert not any(set(o.tokens) < set(r.tokens) for o in mined)
    verdicts = url_rules.judged(pages, labels, F.col("quality") == 0, [("allow", "none.org", "/")], support=15, confidence=0.7)
    want = {i: "block" if any(set(r.tokens) <= s for r in mined) else "allow" for i, s in sets.items()}
    assert {r.page_id: r.verdict for r in verdicts.collect()} == want and "block" in want.values()
