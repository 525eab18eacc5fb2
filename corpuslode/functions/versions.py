"""Version strings and advisory fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INVALID = "0.0.0"


def parse_version(spec: Column) -> Column:
    """Plain version of a dependency spec; tags, files and repositories give 0.0.0."""
    v = F.regexp_replace(spec, r"^[\^~>=<]+", "")
    v = F.trim(F.regexp_replace(F.regexp_replace(v, r"\s+\|\|.*$", ""), r"\s+-\s+.*$", ""))
    v = F.when(v.startswith("workspace:"), F.regexp_replace(F.replace(v, F.lit("workspace:"), F.lit("")), r"^([^\^~*]*)[\^~*]", "$1")).otherwise(v)
    alias = F.regexp_extract(v, r"@([\d.]+)", 1)
    v = F.when(v.startswith("npm:") & (alias != ""), alias).otherwise(v)
    unknown = v.contains("git") | v.startswith("file:") | v.isin("latest", "next", "*", "")
    return F.when(unknown, INVALID).otherwise(v)


def is_valid_version(version: Column) -> Column:
    return (version != INVALID) & version.rlike(r"^\d+\.\d+")


def version_key(version: Column) -> Column:
    """Array that sorts like versions: three numbers, then 0 before 1 for pre-releases."""
    core = F.regexp_extract(version, r"^(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(F.concat(core, F.lit(".0.0.0")), r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
    return F.array_append(F.slice(parts, 1, 3), F.when(version.rlike(r"^\d+(?:\.\d+)*-"), F.lit(0)).otherwise(F.lit(1)).cast("bigint"))


def cvss_to_severity(score: Column) -> Column:
    return (
        F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").otherwise("info")
    )


# Severity words of advisory databases.
DATABASE_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium", "medium": "medium", "low": "low"}


def advisory_severity(advisory_id: Column, severities: Column, database: Column, compat: bool = False) -> Column:
    """Severity from the first numeric CVSS score, else the database's word, else the id.

    ``compat=True`` takes the first number of any score text, so a vector text
    counts as its version number.
    """
    pattern = r"(\d+\.?\d*)" if compat else r"^(\d+\.?\d*)$"
    scores = F.filter(severities, lambda s: s["type"].isin("CVSS_V3", "CVSS_V2") & s["score"].rlike(pattern))
    score = F.regexp_extract(F.try_element_at(scores, F.lit(1))["score"], pattern, 1).try_cast("double")
    word = F.lower(database)
    named = F.lit(None).cast("string")
    for name, value in DATABASE_SEVERITY.items():
        named = F.when(word == name, value).otherwise(named)
    default = F.when(advisory_id.startswith("GHSA-"), "high").otherwise("medium")
    return F.when(score.isNotNull(), cvss_to_severity(score)).otherwise(F.coalesce(named, default))


def advisory_cves(advisory_id: Column, aliases: Column) -> Column:
    every = F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.array(advisory_id))
    return F.array_distinct(F.filter(every, lambda a: a.startswith("CVE-")))


def advisory_fixed(affected: Column) -> Column:
    """First fixed version over all affected packages, ranges and events."""
    ranges = F.flatten(F.transform(affected, lambda a: a["ranges"]))
    events = F.flatten(F.transform(ranges, lambda r: r["events"]))
    return F.try_element_at(F.filter(events, lambda e: e["fixed"].isNotNull()), F.lit(1))["fixed"]


def advisory_url(references: Column) -> Column:
    """Preferred reference: GitHub advisory, then npm advisory, then any advisory, then the first."""
    first = lambda test: F.try_element_at(F.filter(references, test), F.lit(1))["url"]
    return F.coalesce(
        first(lambda r: r["url"].contains("github.com/advisories")), first(lambda r: r["url"].contains("npmjs.com/advisories")),
        first(lambda r: r["type"] == "ADVISORY"), F.try_element_at(references, F.lit(1))["url"])
