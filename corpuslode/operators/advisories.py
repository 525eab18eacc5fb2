"""Dependencies against advisories: lockfile override, version range join, findings, hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions as vs
from ..functions.paths import any_contains
from ..sources.manifests import parse_manifests
from .ranking import SEVERITY_ORDER, rank_of

DEPENDENCY_CONFIDENCE = 0.95


def with_locked_versions(dependencies: DataFrame, locked: DataFrame) -> DataFrame:
    """Use the locked version where the lockfile has one."""
    return dependencies.join(locked, ["project", "name"], "left").withColumn("version", F.coalesce("locked", "version")).drop("locked")


def advisory_ranges(advisories: DataFrame, compat: bool = False, ecosystem: str = "npm") -> DataFrame:
    """One row per advisory, package and affected range or listed version, with the advisory's facts.

    Packages of other ecosystems and ranges of other kinds (hashes of a
    repository) are left out.  Each introduction ends at the next fix after it, in
    the order of versions; an introduction without one stays open.
    """
    severities = F.coalesce("severity", F.try_element_at("affected", F.lit(1))["severity"])
    facts = advisories.select(
        "id", "summary",
        vs.advisory_severity(F.col("id"), severities, F.col("database_specific.severity"), compat).alias("severity"),
        vs.advisory_cves(F.col("id"), F.col("aliases")).alias("cves"),
        vs.advisory_fixed(F.col("affected")).alias("fixed_in"),
        vs.advisory_url(F.col("references")).alias("url"),
        F.explode("affected").alias("a"),
    ).filter(F.col("a.package.ecosystem") == ecosystem)
    kept = ["id", "summary", "severity", "cves", "fixed_in", "url"]
    named = facts.select(*kept, F.col("a.package.name").alias("name"), "a.ranges", "a.versions")
    ranged = named.select(*kept, "name", F.explode("ranges").alias("r")).filter(F.col("r.type").isin("SEMVER", "ECOSYSTEM"))
    opened = F.filter("r.events", lambda e: e["introduced"].isNotNull())
    closed = F.filter("r.events", lambda e: e["fixed"].isNotNull())

    def after(start: Column) -> Column:
        fixes = F.transform(closed, lambda e: F.struct(vs.version_key(e["fixed"]).alias("key"), e["fixed"].alias("fixed")))
        return F.array_min(F.filter(fixes, lambda x: x["key"] > vs.version_key(start)))["fixed"]

    spans = F.transform(opened, lambda e: F.struct(e["introduced"].alias("introduced"), after(e["introduced"]).alias("fixed")))
    ranges = ranged.select(*kept, "name", F.explode(spans).alias("p")).select(
        *kept, "name", F.col("p.introduced").alias("introduced"), F.col("p.fixed").alias("fixed"), F.lit(None).cast("string").alias("listed"))
    none = F.lit(None).cast("string")
    listed = named.select(*kept, "name", none.alias("introduced"), none.alias("fixed"), F.explode("versions").alias("listed"))
    return ranges.unionByName(listed)


def vulnerable_dependencies(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """Dependencies whose version is listed or lies in an affected range: introduced <= version < fixed.

    Versions are matched once per distinct (package, version), so a package that a
    third of all projects use is one row here; the hits then join back by key.
    """
    valid = dependencies.filter(vs.is_valid_version(F.col("version")))
    asked = valid.select("name", "version").distinct().withColumn("key", vs.version_key(F.col("version")))
    bounds = ranges.withColumn("low", vs.version_key(F.coalesce("introduced", F.lit("0")))).withColumn("high", vs.version_key(F.col("fixed")))
    inside = (F.col("key") >= F.col("low")) & (F.col("fixed").isNull() | (F.col("key") < F.col("high")))
    hit = F.when(F.col("listed").isNotNull(), F.col("listed") == F.col("version")).otherwise(inside)
    hits = asked.join(bounds, "name").filter(hit).groupBy("name", "version", "id").agg(
        *[F.first(c).alias(c) for c in ("summary", "severity", "cves", "fixed_in", "url")])
    return valid.join(hits, ["name", "version"])


def dependency_findings(vulnerable: DataFrame) -> DataFrame:
    """Advisory hits as finding rows on the manifest."""
    title = F.concat("name", F.lit("@"), "version", F.lit(": "), F.coalesce("summary", F.lit("Known vulnerability")))
    return vulnerable.select(
        "project", F.lit("package.json").alias("path"), F.lit(0).alias("line"), title.alias("title"), F.col("id").alias("rule_id"),
        F.lit("dependencies").alias("family"), F.lit("dependencies").alias("category"), F.lit("A06:2021-Vulnerable Components").alias("owasp"),
        "severity", F.lit("needs_fix").alias("status"), F.lit(DEPENDENCY_CONFIDENCE).alias("confidence"),
        F.col("fixed_in").isNotNull().alias("auto_fixable"), F.try_element_at("cves", F.lit(1)).alias("cwe"))


def dependency_counts(dependencies: DataFrame, vulnerable: DataFrame) -> DataFrame:
    totals = dependencies.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_dev")).alias("production"), F.count_if("is_dev").alias("development"))
    hit = vulnerable.select("project", "name", "version", "is_dev", "is_peer", "is_optional").distinct().groupBy("project").agg(
        F.count(F.lit(1)).alias("vulnerable"))
    return totals.join(hit, "project", "left").na.fill(0, ["vulnerable"])


def vulnerabilities_by_severity(vulnerable: DataFrame) -> DataFrame:
    return vulnerable.groupBy("severity").agg(F.count(F.lit(1)).alias("vulnerabilities"), F.countDistinct("name").alias("packages")).withColumn(
        "severity_rank", rank_of(F.col("severity"), SEVERITY_ORDER))


# Configuration files of update bots, first one counts.
BOT_FILES = [
    "renovate.json", "renovate.json5", ".renovaterc", ".renovaterc.json", ".github/renovate.json", ".github/dependabot.yml",
    ".github/dependabot.yaml",
]


def hygiene_practices(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Good dependency practices of a project, from its manifest and configuration files."""
    m = parse_manifests(manifests).select("project", F.col("m.engines").isNotNull().alias("engines"),
                                          (F.col("m.overrides").isNotNull() | F.col("m.resolutions").isNotNull()).alias("overrides"))
    path, text = F.col("path"), F.col("content")
    npmrc = path == ".npmrc"
    bots = F.array(*[F.lit(b) for b in BOT_FILES])
    place = F.array_position(bots, path)
    seen = files.groupBy("project").agg(
        F.max(path == "package-lock.json").alias("lockfile"),
        F.max(npmrc & (text.contains("audit=true") | ~text.contains("audit=false"))).alias("audit"),
        F.max(npmrc & text.contains("ignore-scripts=true")).alias("scripts"),
        F.max(path == ".snyk").alias("snyk"),
        F.min(F.when(place > 0, place)).alias("bot"))
    joined = m.join(seen, "project", "left")
    tool = F.when(F.element_at(bots, F.col("bot").cast("int")).contains("dependabot"), "Dependabot").otherwise("Renovate")
    titles = F.array_compact(F.array(
        F.when(F.col("lockfile"), "Package Lockfile Present"), F.when(F.col("engines"), "Node.js Engine Constraints"),
        F.when(F.col("overrides"), "Dependency Overrides/Resolutions"), F.when(F.col("audit"), "npm Audit Enabled"),
        F.when(F.col("scripts"), "npm Scripts Disabled"), F.when(F.col("snyk"), "Snyk Security Configuration"),
        F.when(F.col("bot").isNotNull(), F.concat(tool, F.lit(" Automated Updates")))))
    return joined.select("project", F.lit("dependencies").alias("category"), F.explode(titles).alias("title"))
