"""URL filtering by association rules.

A URL is a set of tokens: labels of its host, segments of its path, keys of its query. FP-growth
mines token combinations from the URLs of labelled pages in which the label takes part;
a combination whose presence makes the bad label likely enough (``confidence``), on enough
pages (``support``), and that no shorter rule implies, is a rule. Rules are found through an
inverted index: every rule is filed under its rarest token, URLs meet rules by tokens, and
a rule fits if all of its tokens are there. Tokens of a hot host meet only the rules filed under them.

Beside the mined rules there may be given ones: (action, host, path) fit their host and
all its subdomains where the URL's path begins with theirs; the longest rule (host and
path together) wins, and beats the mined rules. A URL looks up each of its hosts'
suffixes; the few paths given for one are compared.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no
given rule and is judged by its tokens, if any. Equal rows get equal verdicts. Without labels of
both kinds nothing is mined and every other URL is allowed. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, lower_ascii

BAD = "=bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens, each marked with its part of the URL."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    mark = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    segments = F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: ~F.rlike(x, F.lit("^[0-9]*$")))
    keys = F.transform(F.split(F.lower(query), "&"), lambda x: F.element_at(F.split(x, "="), 1))
    words = F.filter(F.split(host, "[^a-z0-9]+"), lambda x: F.length(x) > 1)
    return F.array_distinct(F.concat(mark("h:", words), mark("d:", F.array(host)), mark("p:", segments), mark("q:", keys)))


def mine(pages: DataFrame, labels: DataFrame, id_col: str, label: Column, support: int = 20, confidence: float = 0.5) -> DataFrame:
    """Rules (rule, tokens, alike, confidence, lift, pages) from ``pages`` (id, tokens) whose label is known.

    ``label`` is true for bad ones. Tokens that the same labelled pages have (a host and its labels, the segments of
    one shared path) are one item, as any combination of them says the same: ``tokens`` names the first of each such group and
    ``alike`` all of them. So long shared paths don't multiply combinations; those of tokens that
    differ on some page do, each with ``support`` pages at least.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = pages.sparkSession
    known = labels.where(F.col("label_id").isNotNull()).groupBy("label_id").agg(F.max(label.cast("int")).alias("bad")).where("bad is not null")
    rows = cut(pages.join(known, pages[id_col] == known["label_id"]).select("tokens", "bad"), "baskets")
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    empty = spark.createDataFrame([], "rule bigint, tokens array<string>, alike array<array<string>>, confidence double, lift double, pages bigint")
    if not bad or bad == total:
        return empty
    # a rule has a token of bad pages only if that occurs on enough of them
    often = rows.where("bad = 1").select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= support).select("t")
    of_all = rows.withColumn("page", F.monotonically_increasing_id())
    kept = cut(of_all.select("page", "bad", F.explode("tokens").alias("t")).join(often, "t", "left_semi"), "kept")
    pages_of = kept.groupBy("t").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page")).alias("x"), F.bit_xor(F.xxhash64("page", F.lit("again"))).alias("y"))
    groups = cut(pages_of.groupBy("n", "x", "y").agg(F.sort_array(F.collect_list("t")).alias("alike")).select(F.col("alike")[0].alias("t"), "alike"), "groups")
    kept = kept.join(groups.select("t"), "t", "left_semi")
    baskets = kept.groupBy("page").agg(F.collect_set("t").alias("t"), F.first("bad").alias("bad"))
    baskets = baskets.select(F.when(F.col("bad") == 1, F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support / total), minConfidence=confidence).fit(cut(baskets, "items"))
    rules = model.associationRules.where(F.array_contains("consequent", BAD))
    rules = cut(rules.select(F.sort_array("antecedent").alias("tokens"), "confidence", "lift", F.round(F.col("support") * total).cast("long").alias("pages")), "rules")
    # a longer rule says nothing new where a shorter one fits
    rules = rules.withColumn("rule", F.xxhash64("tokens"))
    implied = matched(rules.select(F.col("rule").alias("more"), "tokens"), rules, "more").where(F.col("more") != F.col("rule"))
    rules = rules.join(implied.select(F.col("more").alias("rule")).distinct(), "rule", "left_anti")
    named = rules.select("rule", F.explode("tokens").alias("t")).join(groups, "t").groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "alike"))), lambda g: g["alike"]).alias("alike"))
    return rules.join(named, "rule").select("rule", "tokens", "alike", "confidence", "lift", "pages")


def renamed(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, tokens) with each token that the rules know under the name of its group, and no other."""
    names = rules.select(F.explode(F.arrays_zip("tokens", "alike")).alias("g")).select(F.col("g.tokens").alias("name"), F.explode("g.alike").alias("t")).distinct()
    return pages.select(key, F.explode("tokens").alias("t")).join(names, "t").groupBy(key).agg(F.collect_set("name").alias("tokens"))


def matched(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule) of the rules whose tokens are all among the page's ``tokens``."""
    index = rules.select("rule", F.col("tokens").alias("needed"), F.explode("tokens").alias("t"))
    often = pages.select(F.explode("tokens").alias("t")).groupBy("t").count()
    counted = index.join(often, "t", "left").groupBy("rule", "needed").agg(F.min_by("t", F.struct(F.coalesce("count", F.lit(0)), "t")).alias("t"))
    found = pages.select(key, "tokens", F.explode("tokens").alias("t")).join(counted, "t")
    return found.where(F.size(F.array_except("needed", "tokens")) == 0).select(key, "rule").distinct()


def given_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) as a table, one row a host with its paths, longest first."""
    rows = spark.createDataFrame(rules, "action string, suffix string, prefix string")
    of_host = F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("size"), "prefix", "action")), asc=False)
    return rows.groupBy("suffix").agg(of_host.alias("paths"))


def judged(pages: DataFrame, labels: DataFrame, label: Column, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", **mining) -> DataFrame:
    """Every page's id, host, path, rule, verdict and number of mined rules that fit it."""
    spark = pages.sparkSession
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"))
    # judge each URL once, however many rows have it
    urls = cut(rows.groupBy("url").agg(F.count("*").alias("rows")).select("url", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens")), "urls")
    known = rows.select("id", tokens_of(F.col("url")).alias("tokens"))
    mined = cut(mine(known, labels.withColumnRenamed(label_id, "label_id"), "id", label, **mining), "mined")
    fitting = matched(cut(renamed(urls.where("url is not null"), mined, "url"), "renamed"), mined, "url").groupBy("url").agg(F.count("*").alias("mined"))

    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    looked = urls.where("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix")).join(F.broadcast(given_rules(spark, rules)), "suffix")  # the rules are an argument
    fits = F.filter("paths", lambda p: F.startswith(F.col("path"), p["prefix"]))
    looked = looked.withColumn("p", F.get(fits, F.lit(0)))
    best = looked.where("p is not null").groupBy("url").agg(F.max(F.struct((F.length("suffix") + F.col("p.size")).alias("size"), F.col("p.size").alias("of_path"), F.concat(F.col("suffix"), F.col("p.prefix")).alias("rule"), F.col("p.action").alias("action"))).alias("b"))
    verdicts = urls.drop("tokens").join(best, "url", "left").join(fitting, "url", "left")
    verdict = F.coalesce(F.col("b.action"), F.when(F.col("mined") > 0, "block").otherwise("allow"))
    verdicts = verdicts.select(F.col("url").alias("_url"), "host", "path", F.col("b.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("mined", F.lit(0)).alias("mined"))
    return rows.join(verdicts, rows["url"].eqNullSafe(verdicts["_url"])).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "mined")
