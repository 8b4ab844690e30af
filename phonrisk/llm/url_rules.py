"""URL filter: given host and path rules, then association rules mined from labelled URLs.

A URL becomes a set of tokens: its host, each parent domain, the words of host and path (digits apart)
and the names of query keys. From the labelled URLs, FP-growth mines the token sets that are frequent
among blocked ones; a set whose share of blocked URLs (confidence) and number of them (support) are
high enough is a block rule. Single tokens are counted first: one that makes a rule by itself is not mined
further, since it implies every set that it is in, and tokens that stand in the same labelled URLs are
mined as one and written out again, so that the tokens of a shared URL shape do not multiply.
Rules have at most ``MAX_TOKENS`` tokens. Rules that a shorter one implies are pruned, and the rest is
matched through an inverted index: a rule is filed under its first token, a URL looks up its own tokens, and a rule
fires where all of its tokens are there. The rest is allowed.

Support is an absolute count (``MIN_COUNT`` blocked URLs), whatever the number of labelled URLs. Up to ``BROADCAST_RULES``
rules are broadcast; more are matched by a plain join on the first token. No rule is dropped.

Given rules fit a host and its subdomains, if the path starts with the rule's; the longest wins:
longest host, then longest path.

Defined cases: a null url or one without ``://`` has empty host and path, matches nothing and is allowed;
without labels there are no mined rules; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.llm.store import stored

MIN_CONFIDENCE = 0.6
MIN_COUNT = 20
MAX_TOKENS = 3
BROADCAST_RULES = 10_000
BLOCKED = "label=block"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, F.size(labels) - k + 1), ".")))
    words = F.concat(F.transform(F.split(host, r"[^a-z0-9]+"), lambda w: F.concat(F.lit("host word="), w)),
                     F.transform(F.split(F.lower(path), r"[^\p{L}]+"), lambda w: F.concat(F.lit("path word="), w)),
                     F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda w: F.concat(F.lit("query key="), w)))
    found = F.array_distinct(F.filter(F.concat(parents, words), lambda t: ~t.endswith("=")))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits; rules are (verdict, ``host/path``) texts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1].partition("/")[0]), len(r[1]))):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def shortest(rules: DataFrame) -> DataFrame:
    """Rules (sets of at most ``MAX_TOKENS`` = 3 ``items``) of which no part is a rule: wherever the longer one fires, the shorter does."""
    items = F.col("items")
    parts = F.concat(F.transform(items, lambda t: F.array(t)), F.transform(items, lambda t: F.array_remove(items, t)))
    parts = rules.select("items", F.explode(F.filter(F.array_distinct(parts), lambda x: (F.size(x) > 0) & (F.size(x) < F.size(items)))).alias("part"))
    implied = parts.join(rules.select(items.alias("part")), "part").select("items").distinct()
    return rules.join(implied, "items", "left_anti")


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(first, rest, confidence, support): block rules mined from rows of (url, blocked)."""
    baskets = labelled.select(tokens_of(F.col("url")).alias("tokens"), "blocked").filter(F.size("tokens") > 0)
    # Numbered and stored once: a lost task must not number anew, and three jobs read it.
    baskets = stored(baskets.withColumn("row", F.monotonically_increasing_id()), "baskets")
    n = baskets.count()
    schema = "first string, rest array<string>, confidence double, support long"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    # Only tokens that are frequent among blocked URLs can make a rule. The sum of the rows' hashes tells which stand in the same rows.
    hashed = F.sum(F.xxhash64("row").cast("decimal(20, 0)")).cast("string")
    tokens = baskets.select("row", "blocked", F.explode("tokens").alias("t")).groupBy("t").agg(
        F.count("*").alias("all"), F.count_if("blocked").alias("freq"), hashed.alias("rows")).filter(F.col("freq") >= min_count)
    tokens = stored(tokens.withColumn("confidence", F.col("freq") / F.col("all")), "tokens")
    single = tokens.filter(F.col("confidence") >= min_confidence).select(F.array("t").alias("items"), "confidence", "freq")
    rest = tokens.filter(F.col("confidence") < min_confidence)
    classes = stored(rest.groupBy("all", "rows").agg(F.min("t").alias("kind"), F.collect_list("t").alias("ts")).select("kind", F.explode("ts").alias("t")), "classes")
    kinds = F.when(F.col("blocked"), F.array("t", F.lit(BLOCKED))).otherwise(F.array("t"))
    seen = baskets.select("row", "blocked", F.explode("tokens").alias("t")).join(classes.filter("t = kind"), "t")
    seen = seen.select("row", F.explode(kinds).alias("t")).groupBy("row").agg(F.sort_array(F.collect_set("t")).alias("items"))
    seen = stored(seen, "kinds")
    m = seen.count()
    if m < min_count:
        return _filed(single)
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / m, minConfidence=min_confidence).fit(seen)
    sets = stored(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq").filter(F.size("items") <= MAX_TOKENS + 1), "itemsets")
    whole = sets.filter(~F.array_contains("items", BLOCKED)).withColumnRenamed("freq", "all")
    bad = sets.filter(F.array_contains("items", BLOCKED) & (F.size("items") > 2)).select(F.array_remove("items", BLOCKED).alias("items"), "freq")
    mined = bad.join(whole, "items").withColumn("confidence", F.col("freq") / F.col("all")).filter(
        (F.col("confidence") >= min_confidence) & (F.col("freq") >= min_count)).select("items", "confidence", "freq")
    return _filed(single.union(_written_out(shortest(stored(mined, "candidates")), classes)))


def _filed(rules: DataFrame) -> DataFrame:
    """Rules under their first token."""
    return rules.select(F.get("items", F.lit(0)).alias("first"), F.expr("slice(items, 2, size(items))").alias("rest"), "confidence", F.col("freq").alias("support"))


def _written_out(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Every rule with each of the tokens that its tokens stand for."""
    out = rules.select(F.array().cast("array<string>").alias("done"), "items", "confidence", "freq")
    for k in range(MAX_TOKENS):
        short, long = out.filter(F.size("items") <= k), out.filter(F.size("items") > k)
        long = long.join(classes, F.get("items", F.lit(k)) == F.col("kind")).select(F.concat("done", F.array("t")).alias("done"), "items", "confidence", "freq")
        out = short.union(long)
    return out.select(F.sort_array("done").alias("items"), "confidence", "freq")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, broadcast_rules: int = BROADCAST_RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and ``mined`` (how many mined rules fire) of every row of (page_id, url)."""
    mined = stored(mine(labelled, **options), "rules")
    filed = F.broadcast(mined) if mined.limit(broadcast_rules + 1).count() <= broadcast_rules else mined
    known = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row"))
    known = stored(known.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "tokens": tokens_of(F.col("url"))}), "pages")
    fired = known.select("row", "tokens", F.explode("tokens").alias("first")).join(filed, "first").filter(F.expr("size(array_except(rest, tokens)) = 0"))
    fired = fired.groupBy("row").agg(F.count("*").alias("mined"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    out = known.drop("tokens").join(fired, "row", "left").withColumn("mined", F.coalesce("mined", F.lit(0)))
    verdict = F.coalesce(verdict, F.when(F.col("mined") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "mined")
