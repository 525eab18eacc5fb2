"""URL filter: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii

# A rule index up to this many rules is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host and path, written together; ``literals`` are lower-case tokens every match contains.

    Of the rules that match, the highest ``rank`` decides, then ``block``, then the name.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...] = ()
    rank: int = 0


def prefix_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A host with all its subdomains and a path prefix; longer rules rank higher, above all pattern rules."""
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    host_tokens = re.findall(r"[a-z0-9]+", host)
    # The path's last token may go on in the url, so only those before its last separator are whole.
    path_tokens = re.findall(r"([a-z0-9]+)(?=[^a-z0-9])", path.lower())
    return UrlRule(host + path, verdict, pattern, tuple(host_tokens + path_tokens), 1000 + len(host + path))


def token_rule(name: str, *tokens: str, verdict: str = "block") -> UrlRule:
    """Whole tokens that follow each other, parted by one other character."""
    return UrlRule(name, verdict, r"(?i)(?<![a-z0-9])" + r"[^a-z0-9]".join(map(re.escape, tokens)) + r"(?![a-z0-9])", tokens)


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one and for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(target), r"[^a-z0-9]+"))


def rule_index(targets: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """One row per rule under the literal token that the fewest of ``targets`` (column ``target``) hold.

    Rules without a literal stand under the empty token, which every url is given.
    """
    spark = targets.sparkSession
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.literals) or [""], r.rank) for r in rules],
                                  "rule string, verdict string, pattern string, literals array<string>, rank int")
    literals = table.select("rule", "verdict", "pattern", "rank", F.explode("literals").alias("token"))
    wanted = literals.select("token").distinct()
    if len(rules) <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    seen = targets.select(F.explode(url_tokens(F.col("target"))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    return (literals.join(seen, "token", "left")
            .groupBy("rule", "verdict", "pattern", "rank")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    Distinct host and path pairs are judged once: their tokens fetch candidate
    rules, and only a candidate's regular expression runs.  ``rule`` is the
    deciding rule, null if none matches, and then ``default`` is the verdict.
    Null urls and urls without ``://`` have an empty host and path.  Rows that
    repeat are judged alike and all returned.
    """
    split = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    targets = split.select("host", "path").distinct().withColumn("target", F.concat("host", "path"))
    index = rule_index(targets, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    tokens = F.array_union(url_tokens(F.col("target")), F.array(F.lit("")))
    candidates = targets.withColumn("token", F.explode(tokens)).join(index, "token")
    best = F.max(F.struct("rank", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best")
    matched = candidates.where("target rlike pattern").groupBy("host", "path").agg(best)
    return (split.join(matched, ["host", "path"], "left")
            .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce(F.col("best.verdict"), F.lit(default))}).drop("best")
            .select(*split.columns, "rule", "verdict"))


# Host and path rules of the url query.
BASE_RULES = [
    prefix_rule("net", "/", "block"),
    prefix_rule("example.net", "/en/", "allow"),
    prefix_rule("example.com", "/de/", "block"),
    prefix_rule("org", "/fr/", "allow"),
]

# Pattern rules of our own: token sequences of gambling, pharmacy, adult and spam sites.
PATTERN_RULES = [
    token_rule("gambling", "casino"), token_rule("free bets", "free", "bets"), token_rule("slots", "online", "slots"),
    token_rule("poker", "poker"), token_rule("pills", "cheap", "pills"), token_rule("viagra", "viagra"),
    token_rule("pharmacy", "online", "pharmacy"), token_rule("porn", "porn"), token_rule("xxx", "xxx"),
    token_rule("sex cam", "sex", "cam"), token_rule("loans", "payday", "loans"), token_rule("warez", "warez"),
    token_rule("get rich", "get", "rich"), token_rule("replica", "replica", "watches"),
]
