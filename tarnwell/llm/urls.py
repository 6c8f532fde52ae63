"""URL filtering by fixed rules and mined association rules.

FP-growth finds combinations of URL tokens that occur together with a label;
those with enough support and confidence are kept as rules.  A rule is indexed
under the token that is rarest among the URLs to be judged, so that a URL meets
only rules of such tokens, and is then checked for the rest.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BLOCK = "\x01block"
#: Labelled URLs a combination must occur in, as a share of all of them.
MIN_SUPPORT = 0.004
MIN_CONFIDENCE = 0.6
#: How much likelier than usual a URL of the combination must be blocked.
MIN_LIFT = 1.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (ASCII lower case) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return F.translate(raw, upper, lower), F.regexp_extract(tail, r"(?s)^[^?#]*", 0)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The name and verdict of the longest of ``rules(verdict, host, path)`` that fits, or nulls.

    A rule fits its host and the host's subdomains where the path begins with
    the rule's.  Longest is by the rule's whole length, then its name.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels, path segments, query names."""
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1))))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.lower(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    every = F.when(host != "", F.concat(scheme, labels, segments, names)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(every, lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame | None:
    """Rules ``(rule array<string>, confidence, support)`` from ``labelled(tokens, bad)``.

    None where there is nothing to mine (no labelled URL, or none bad).
    Rows whose label is null take no part; rows that repeat count each.  All
    combinations of enough support are rules, however many tied at a bound.
    """
    baskets = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select(
        F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"), "bad"
    )
    baskets = saved(baskets, "baskets")
    seen = baskets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("bad")).first()
    if not seen["bad"]:
        return None
    growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    growth.setNumPartitions(max(1, baskets.rdd.getNumPartitions()))
    found = growth.fit(baskets.select("items")).associationRules
    rules = found.where(
        (F.size("consequent") == 1)
        & (F.col("consequent")[0] == BLOCK)
        & (F.col("confidence") >= min_lift * seen["bad"] / seen["n"])
    )
    return saved(rules.select(F.col("antecedent").alias("rule"), "confidence", "support"), "rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Ids of ``urls(page_id, tokens)`` that some rule fits, with the best confidence.

    A rule stands in the index under that of its tokens that the fewest of the
    URLs have (of equally rare ones the first), so that a token that all URLs
    have leads to no rule that a rarer one leads to.  A rule with a token that
    no URL has fits none.
    """
    probes = urls.select("page_id", "tokens", F.explode("tokens").alias("anchor"))
    spread = rules.select("rule", "confidence", F.explode("rule").alias("token"))
    wanted = spread.select(F.col("token").alias("wanted")).distinct()
    common = probes.join(wanted, F.col("anchor") == F.col("wanted")).groupBy(F.col("wanted").alias("met")).agg(F.count("*").alias("uses"))
    index = (
        spread.join(common, F.col("token") == F.col("met"))
        .groupBy("rule", "confidence")
        .agg(F.min_by("token", F.struct("uses", "token")).alias("key"), F.count("*").alias("tokens_met"))
        .where(F.col("tokens_met") == F.size("rule"))
    )
    fits = probes.join(index, F.col("anchor") == F.col("key")).where(F.size(F.array_except("rule", "tokens")) == 0)
    return fits.groupBy("page_id").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], bad: Column) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per page.

    The longest fixed rule decides; else a page is blocked if a mined rule fits
    it.  ``bad`` tells from a row of ``labels(doc_id, ...)`` whether the page of
    that id is to be blocked; of repeated labels the worse counts.  Null urls
    and urls without ``://`` have an empty host and path and no tokens.  Rows
    that repeat a page_id are judged each; a null page_id is judged by fixed
    rules only.  No labels: only the fixed rules block.  Other columns are
    ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "host", "path", name.alias("rule"), verdict.alias("fixed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    parsed = saved(parsed, "urls")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("bad"))
    mined = mine(parsed.join(known, F.col("page_id") == F.col("doc_id")).select("tokens", "bad"))
    if mined is None:
        blocked = parsed.select("page_id").where("false").select(F.col("page_id").alias("_id"))
    else:
        open_urls = parsed.where("fixed IS NULL AND page_id IS NOT NULL")
        blocked = matches(open_urls, mined).select(F.col("page_id").alias("_id"))
    judged = parsed.join(blocked, F.col("page_id") == F.col("_id"), "left")
    by_method = F.when(F.col("_id").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", by_method).alias("verdict"))
