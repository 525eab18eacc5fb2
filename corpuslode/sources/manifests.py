"""Dependency manifests, lockfiles and advisory dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.versions import parse_version

NAMES = "map<string,string>"
MANIFEST = (f"dependencies {NAMES}, devDependencies {NAMES}, peerDependencies {NAMES}, optionalDependencies {NAMES}, "
            f"engines {NAMES}, overrides {NAMES}, resolutions {NAMES}")
LOCKED = "map<string,struct<version:string>>"
LOCKFILE = f"lockfileVersion int, packages {LOCKED}, dependencies {LOCKED}"
ADVISORY = (
    "id string, summary string, details string, aliases array<string>, references array<struct<type:string,url:string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,"
    "events:array<struct<introduced:string,fixed:string>>>>,versions:array<string>,severity:array<struct<type:string,score:string>>>>, "
    "severity array<struct<type:string,score:string>>, database_specific struct<severity:string>"
)

# Manifest sections in collection order (section, dev, optional, peer).
SECTIONS = [
    ("dependencies", False, False, False), ("devDependencies", True, False, False),
    ("peerDependencies", False, False, True), ("optionalDependencies", False, True, False),
]


def parse_manifests(manifests: DataFrame, json: str = "json") -> DataFrame:
    keep = [c for c in manifests.columns if c != json]
    return manifests.select(*keep, F.from_json(json, MANIFEST).alias("m"))


def read_manifests(manifests: DataFrame, include_dev: bool = True, include_optional: bool = False, json: str = "json") -> DataFrame:
    """One row per declared dependency; a manifest is read once, whatever its sections."""
    empty = F.expr("array()").cast("array<struct<key:string,value:string>>")
    listed = []
    for section, dev, optional, peer in SECTIONS:
        if (dev and not include_dev) or (optional and not include_optional):
            continue
        def rows(section=section, dev=dev, optional=optional, peer=peer):
            return F.transform(F.coalesce(F.map_entries(F.col(f"m.{section}")), empty), lambda e: F.struct(
                e["key"].alias("name"), e["value"].alias("spec"), F.lit(dev).alias("is_dev"), F.lit(optional).alias("is_optional"),
                F.lit(peer).alias("is_peer")))
        listed.append(rows())
    found = parse_manifests(manifests, json).select("project", F.explode(F.concat(*listed)).alias("d")).select("project", "d.*")
    return found.withColumn("version", parse_version(F.col("spec")))


def read_lockfiles(lockfiles: DataFrame, json: str = "json") -> DataFrame:
    """Locked version by package name; package tables win over the old layout."""
    lock = lockfiles.select("project", F.from_json(json, LOCKFILE).alias("l"))
    prefix = "node_modules/"
    packages = F.transform(
        F.filter(F.map_entries("l.packages"), lambda e: e["key"].startswith(prefix)),
        lambda e: F.struct(F.substr(e["key"], F.lit(len(prefix) + 1)).alias("name"), e["value"]["version"].alias("locked")))
    older = F.transform(F.map_entries("l.dependencies"), lambda e: F.struct(e["key"].alias("name"), e["value"]["version"].alias("locked")))
    entries = F.when(F.col("l.packages").isNotNull(), packages).otherwise(older)
    return lock.select("project", F.explode(entries).alias("e")).select("project", "e.name", "e.locked").filter("locked IS NOT NULL")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisory dump, one JSON document per line."""
    return spark.read.schema(ADVISORY).json(path)
