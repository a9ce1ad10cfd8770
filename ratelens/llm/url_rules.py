"""URL filters: listed rules, then association rules mined by FP-growth.

Listed rules are (host, path) prefixes with a verdict; one fits its host and
all subdomains where the url's path starts with the rule's, and the longest
wins.  Urls without a listed rule are judged by association rules:

1. The urls that a listed rule judges are the labelled ones.  A url's tokens
   are its scheme, host labels, path segments and query keys, digits as ``#``.
2. Spark's FP-growth mines the frequent combinations of tokens and label.
   Rules ``tokens -> label`` keep ``min_support`` and ``min_confidence``; a rule
   goes if the same rule with one token fewer is as confident.
3. Rules are found by an inverted index: each is listed under its rarest token,
   a url looks up its own tokens and checks the rest of a rule's tokens.  The
   most confident rule decides (ties: support, then more tokens, then name);
   without one the url is allowed.

Everything is DataFrame functions and Spark ML.  Urls are judged once each, so
a url in a third of all rows is one; the result is joined back by url.

Defined results: a null url or one without ``://`` has empty host and path, no
tokens, and is allowed; repeated rows come back each; ties as above; an empty
table gives an empty result; without labelled urls no rule is mined; other
columns are not carried.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
#: Marks a label among a basket's items; no token starts with it.
LABEL = "="


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*+", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*+([^?#]*+)", 1)


def listed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule of ``rules`` (``host/path`` -> verdict), else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/")
        own = (host == F.lit(rule[:at])) | host.endswith("." + rule[:at])
        out = F.when(own & path.startswith(rule[at:]), F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == F.lit(name), F.lit(verdict)).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: s: scheme, h: host label, p: path segment, q: query key."""

    def tagged(tag: str, parts: Column) -> Column:
        plain = F.filter(parts, lambda x: x != "")
        return F.transform(plain, lambda x: F.concat(F.lit(f"{tag}:"), F.regexp_replace(x, "[0-9]++", "#")))

    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*+)", 1), "&")
    tokens = F.concat(
        tagged("s", F.array(F.translate(F.substring_index(url, "://", 1), UPPER, LOWER))),
        tagged("h", F.split(host, r"\.")),
        tagged("p", F.split(path, "/")),
        tagged("q", F.transform(query, lambda x: F.substring_index(x, "=", 1))),
    )
    judged = url.isNotNull() & (F.locate("://", url) > 0)
    return F.when(judged, F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(tokens, label, confidence, support, key) from rows (tokens, label)."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets
    labels = F.filter("items", lambda x: x.startswith(LABEL))
    plain = F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL)))
    sets = written(sets.select(plain.alias("tokens"), F.get(labels, F.lit(0)).alias("label"), "freq", F.size(labels).alias("labels")))
    rules = sets.where("labels = 1 and size(tokens) > 0").drop("labels")
    alone = sets.where("labels = 0").select("tokens", F.col("freq").alias("all"))
    total = labelled.count()
    rules = rules.join(alone, "tokens").select(
        "tokens",
        F.substring("label", 2, 1000).alias("label"),
        (F.col("freq") / F.col("all")).alias("confidence"),
        (F.col("freq") / F.lit(max(1, total))).alias("support"),
        F.concat_ws(" ", "tokens").alias("key"),
    )
    rules = rules.where(F.col("confidence") >= min_confidence)
    shorter = rules.select(F.col("key").alias("short"), "label", F.col("confidence").alias("as_good"))
    implied = (
        rules.withColumn("token", F.explode("tokens"))
        .withColumn("short", F.concat_ws(" ", F.array_remove("tokens", F.col("token"))))
        .join(shorter, ["short", "label"])
        .where("as_good >= confidence")
        .select("key", "label")
        .distinct()
    )
    rules = rules.join(implied, ["key", "label"], "left_anti")
    # the rarest token: what the fewest labelled urls hold
    single = alone.where("size(tokens) = 1").select(F.col("tokens")[0].alias("token"), F.col("all").alias("seen"))
    index = (
        rules.withColumn("token", F.explode("tokens"))
        .join(single, "token")
        .groupBy("key", "label")
        .agg(F.min_by("token", F.struct("seen", "token")).alias("token"))
    )
    return written(rules.join(index, ["key", "label"]))


def judge_pages(
    pages: DataFrame, rules: dict[str, str], min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the deciding association rule, else null) for every row."""
    url = F.col("url")
    urls = pages.select("url").distinct().withColumn("host", F.coalesce(host_of(url), F.lit(""))).withColumn("path", F.coalesce(path_of(url), F.lit("")))
    urls = urls.withColumn("rule", listed_rule(F.col("host"), F.col("path"), rules))
    urls = written(urls.withColumn("label", verdict_of(F.col("rule"), rules)).withColumn("tokens", tokens_of(url, F.col("host"), F.col("path"))))
    # labels count by row, as often as the pages have the url
    labelled = pages.select("url").join(urls.where("label is not null"), "url").select("tokens", "label")
    mined = mined_rules(labelled, min_support, min_confidence)
    best = (
        urls.where("label is null")
        .select("url", "tokens", F.explode("tokens").alias("token"))
        .join(mined.withColumnRenamed("tokens", "needs").withColumnRenamed("label", "says"), "token")
        .where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("url")
        .agg(F.max_by(F.struct("says", "key"), F.struct("confidence", "support", F.size("needs"), "key", "says")).alias("best"))
    )
    judged = urls.join(best, "url", "left").select(
        F.col("url").alias("_url"),
        "host",
        "path",
        "rule",
        F.coalesce("label", "best.says", F.lit(ALLOW)).alias("verdict"),
        F.col("best.key").alias("mined"),
    )
    return pages.select("page_id", "url").join(judged, F.col("url").eqNullSafe(F.col("_url"))).select("page_id", "host", "path", "rule", "verdict", "mined")
