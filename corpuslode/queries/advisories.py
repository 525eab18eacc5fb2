"""Dependency queries: every order is a project whose line items are its dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions as vs
from ..operators import advisories as ad, architecture as ar, coverage as cv
from ..session import stored
from ..sources import manifests as mf
from .corpus import quoted, table
from .registry import query

# The first package numbers carry names that the framework and test detectors know.
KNOWN = ["nuxt", "vue", "expo", "react-native", "fastify", "react", "vitest", "jest", "mocha", "@playwright/test", "ava", "lodash"]
SPECS = ["^{v}", "~{v}", "{v}", ">={v} || 9.9.9", "workspace:^{v}", "npm:other@{v}", "git+ssh://host/r.git", "latest", "{v} - 8.0.0", "file:../x"]

# Advisories: package number modulo, introduced, fixed, score, alias, database word.
ADVISORIES = [
    ("GHSA-0001", "pkg20", "0", "2.5.0", "9.8", "CVE-2024-0001", None), ("GHSA-0002", "pkg21", "1.0.0", "3.0.0", "7.5", None, None),
    ("OSV-0003", "lodash", "1.2.0", "4.0.0", "5.0", "CVE-2024-0003", None), ("OSV-0004", "react", "2.0.0", "3.3.3", "0.5", None, None),
    ("GHSA-0005", "fastify", "0", None, None, None, "moderate"), ("CVE-2024-0006", "vue", "3.0.0", "4.1.0", None, None, None),
    ("GHSA-0007", "pkg25", "1.1.1", "2.2.2", None, "CVE-2024-0007", None), ("OSV-0008", "pkg30", "0", "9.0.0", "CVSS:3.1/AV:N", None, "critical"),
    ("GHSA-0009", "lodash", "3.0.0", "3.5.0", "9.1", "CVE-2024-0009", None), ("OSV-0010", "jest", "0", "1.5.0", "4.2", None, None),
]

DEPS_SQL = f"""
known AS (SELECT unnest([{', '.join(quoted(k) for k in KNOWN)}]) AS kname, unnest(range({len(KNOWN)})) AS k),
items AS (SELECT l_orderkey AS project, coalesce(kname, 'pkg' || (l_partkey % 50)) AS name, l_linenumber, l_returnflag, l_suppkey, l_partkey,
    (p_size % 5) || '.' || (p_size % 10) || '.' || (l_partkey % 10) AS v
  FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN known ON k = l_partkey % 50),
one AS MATERIALIZED (SELECT project, name, min(l_linenumber) AS n, min(v) AS v, min(l_suppkey) AS s FROM items GROUP BY project, name),
spec AS MATERIALIZED (SELECT *, replace(([{', '.join(quoted(s) for s in SPECS)}])[s % {len(SPECS)} + 1], '{{v}}', v) AS spec, s % {len(SPECS)} AS form,
   CASE WHEN n <= 3 THEN 'prod' WHEN n <= 5 THEN 'dev' WHEN n = 6 THEN 'peer' ELSE 'opt' END AS section FROM one),
deps AS MATERIALIZED (SELECT project, name, spec, section = 'dev' AS is_dev, section = 'opt' AS is_optional, section = 'peer' AS is_peer, v AS locked, s,
   CASE WHEN form IN (6, 7, 9) THEN '0.0.0' ELSE v END AS parsed,
   CASE WHEN s % 3 = 0 THEN v WHEN form IN (6, 7, 9) THEN '0.0.0' ELSE v END AS version FROM spec)"""

RANGES_SQL = f"""
adv(id, name, introduced, fixed, score, alias, word) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else quoted(x) for x in a) + ')' for a in ADVISORIES)}),
ranges AS MATERIALIZED (SELECT *, list_transform(string_split(introduced || '.0.0', '.')[1:3], lambda x: CAST(x AS INT)) AS lo,
   list_transform(string_split(fixed || '.0.0', '.')[1:3], lambda x: CAST(x AS INT)) AS hi,
   CASE WHEN regexp_matches(score, '^\\d+\\.?\\d*$') THEN CASE WHEN CAST(score AS DOUBLE) >= 9 THEN 'critical' WHEN CAST(score AS DOUBLE) >= 7 THEN 'high' WHEN CAST(score AS DOUBLE) >= 4 THEN 'medium' WHEN CAST(score AS DOUBLE) >= 0.1 THEN 'low' ELSE 'info' END
     WHEN word = 'moderate' THEN 'medium' WHEN word IS NOT NULL THEN word WHEN starts_with(id, 'GHSA-') THEN 'high' ELSE 'medium' END AS severity,
   CASE WHEN starts_with(id, 'CVE-') THEN id WHEN alias IS NOT NULL THEN alias ELSE '' END AS cves FROM (SELECT * REPLACE (CASE WHEN score = 'CVSS:3.1/AV:N' THEN NULL ELSE score END AS score) FROM adv)),
vuln AS MATERIALIZED (SELECT d.*, r.id, r.severity, r.cves, r.fixed FROM (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS vk FROM deps WHERE NOT is_optional AND version <> '0.0.0') d
  JOIN ranges r USING (name) WHERE vk >= lo AND (fixed IS NULL OR vk < hi))"""


def _items(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    item = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    number = F.col("l_partkey") % 50
    name = F.coalesce(F.get(F.array(*[F.lit(k) for k in KNOWN]), number.cast("int")), F.concat(F.lit("pkg"), number.cast("string")))
    v = F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 10).cast("string"), (F.col("l_partkey") % 10).cast("string"))
    return item.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("project"), name.alias("name"), "l_linenumber", "l_suppkey", v.alias("v")).groupBy("project", "name").agg(
        F.min("l_linenumber").alias("n"), F.min("v").alias("v"), F.min("l_suppkey").alias("s"))


def manifests(items):
    """Manifest JSON of every order; sections by line number."""
    form = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("s") % len(SPECS) + 1).cast("int"))
    rows = items.withColumn("spec", F.replace(form, F.lit("{v}"), F.col("v")))
    def section(test):
        return F.map_from_entries(F.collect_list(F.when(test, F.struct("name", "spec"))))
    n = F.col("n")
    packed = rows.groupBy("project").agg(
        section(n <= 3).alias("dependencies"), section((n > 3) & (n <= 5)).alias("devDependencies"),
        section(n == 6).alias("peerDependencies"), section(n > 6).alias("optionalDependencies"),
        F.when(F.min("s") % 2 == 0, F.create_map(F.lit("node"), F.lit(">=18"))).alias("engines"),
        F.when(F.min("s") % 5 == 0, F.create_map(F.lit("x"), F.lit("1.0.0"))).alias("overrides"))
    return packed.select("project", F.to_json(F.struct(*[c for c in packed.columns if c != "project"])).alias("json"))


def lockfiles(items):
    """Lockfile JSON of every order; it locks the packages whose supplier number divides by three."""
    rows = items.filter("s % 3 = 0")
    entry = F.struct(F.concat(F.lit("node_modules/"), F.col("name")).alias("k"), F.struct(F.col("v").alias("version")).alias("x"))
    packed = rows.groupBy("project").agg(F.map_from_entries(F.collect_list(entry)).alias("packages"))
    return packed.select("project", F.to_json(F.struct(F.lit(3).alias("lockfileVersion"), "packages")).alias("json"))


def advisories(spark):
    """The advisory table of the queries; a cluster reads a dump with ``read_advisories``."""
    rows = []
    for id_, name, introduced, fixed, score, alias, word in ADVISORIES:
        events = [{"introduced": introduced}] + ([{"fixed": fixed}] if fixed else [])
        rows.append((id_, f"Problem in {name}", None, [alias] if alias else None, [{"type": "WEB", "url": f"https://x/{id_}"}],
                     [{"package": {"ecosystem": "npm", "name": name}, "ranges": [{"type": "SEMVER", "events": events}]}],
                     [{"type": "CVSS_V3", "score": score}] if score else None, {"severity": word} if word else None))
    return spark.createDataFrame(rows, mf.ADVISORY)


def _deps(spark, sf):
    items = stored(_items(spark, sf))  # read by manifests and lockfiles
    return ad.with_locked_versions(mf.read_manifests(manifests(items)), mf.read_lockfiles(lockfiles(items)))


def _vulnerable(spark, sf, deps=None):
    return ad.vulnerable_dependencies(_deps(spark, sf) if deps is None else deps, ad.advisory_ranges(advisories(spark)))


@query("S6 P11 P12", f"""WITH {DEPS_SQL} SELECT project, name, spec, parsed AS version, is_dev, is_optional, is_peer, parsed <> '0.0.0' AS valid FROM deps""")
def manifest_dependencies(spark, sf):
    rows = mf.read_manifests(manifests(_items(spark, sf)), include_optional=True)
    return rows.withColumn("valid", vs.is_valid_version(F.col("version"))).select(
        "project", "name", "spec", "version", "is_dev", "is_optional", "is_peer", "valid")


@query("S7 J4", f"WITH {DEPS_SQL} SELECT project, name, version, is_dev, is_peer FROM deps WHERE NOT is_optional")
def locked_dependencies(spark, sf):
    return _deps(spark, sf).select("project", "name", "version", "is_dev", "is_peer")


@query("J5 S8 P13 P14 P15 P16", f"WITH {DEPS_SQL}, {RANGES_SQL} SELECT project, name, version, id, severity, cves, fixed AS fixed_in FROM vuln")
def vulnerable_dependencies(spark, sf):
    return _vulnerable(spark, sf).select("project", "name", "version", "id", "severity", F.array_join("cves", ",").alias("cves"), "fixed_in")


@query("R6", f"""WITH {DEPS_SQL}, {RANGES_SQL} SELECT project, 'package.json' AS path, CAST(0 AS INT) AS line, name || '@' || version || ': Problem in ' || name AS title,
 id AS rule_id, 'dependencies' AS category, severity, CAST(0.95 AS DOUBLE) AS confidence, fixed IS NOT NULL AS auto_fixable FROM vuln""")
def dependency_findings(spark, sf):
    return ad.dependency_findings(_vulnerable(spark, sf)).select(
        "project", "path", "line", "title", "rule_id", "category", "severity", "confidence", "auto_fixable")


@query("A27", f"""WITH {DEPS_SQL}, {RANGES_SQL} SELECT project, count(*) AS total, count(*) FILTER (NOT is_dev) AS production, count(*) FILTER (is_dev) AS development,
 coalesce(max(v.n), 0) AS vulnerable FROM deps LEFT JOIN (SELECT project, count(DISTINCT name) AS n FROM vuln GROUP BY project) v USING (project) WHERE NOT is_optional GROUP BY project""")
def dependency_counts(spark, sf):
    deps = stored(_deps(spark, sf))  # read for the totals and twice for the hits
    return ad.dependency_counts(deps, _vulnerable(spark, sf, deps))


@query("A28", f"""WITH {DEPS_SQL}, {RANGES_SQL} SELECT severity, count(*) AS vulnerabilities, count(DISTINCT name) AS packages,
 CAST(list_position(['critical','high','medium','low','info'], severity) - 1 AS INT) AS severity_rank FROM vuln GROUP BY severity""")
def vulnerabilities_by_severity(spark, sf):
    return ad.vulnerabilities_by_severity(_vulnerable(spark, sf))


HYGIENE_PATHS = ["package-lock.json", ".npmrc", ".snyk", "renovate.json", ".github/dependabot.yml", "src/index.ts"]


@query("R7", f"""WITH {DEPS_SQL}, m AS (SELECT project, min(s) AS s FROM spec GROUP BY project),
f AS (SELECT l_orderkey AS project, ([{', '.join(quoted(p) for p in HYGIENE_PATHS)}])[l_suppkey % 6 + 1] AS path, CASE l_linenumber % 3 WHEN 0 THEN 'audit=false' WHEN 1 THEN 'ignore-scripts=true' ELSE '' END AS content FROM lineitem),
g AS (SELECT project, bool_or(path = 'package-lock.json') AS lockfile, bool_or(path = '.npmrc' AND content <> 'audit=false') AS audit, bool_or(path = '.npmrc' AND content = 'ignore-scripts=true') AS scripts,
  bool_or(path = '.snyk') AS snyk, bool_or(path = 'renovate.json') AS reno, bool_or(path = '.github/dependabot.yml') AS dep FROM f GROUP BY project)
SELECT project, 'dependencies' AS category, title FROM (SELECT project, unnest(list_filter([CASE WHEN lockfile THEN 'Package Lockfile Present' END, CASE WHEN s % 2 = 0 THEN 'Node.js Engine Constraints' END,
 CASE WHEN s % 5 = 0 THEN 'Dependency Overrides/Resolutions' END, CASE WHEN audit THEN 'npm Audit Enabled' END, CASE WHEN scripts THEN 'npm Scripts Disabled' END, CASE WHEN snyk THEN 'Snyk Security Configuration' END,
 CASE WHEN reno THEN 'Renovate Automated Updates' WHEN dep THEN 'Dependabot Automated Updates' END], lambda x: x IS NOT NULL)) AS title FROM m LEFT JOIN g USING (project))""")
def dependency_hygiene(spark, sf):
    item = table(spark, sf, "lineitem")
    path = F.element_at(F.array(*[F.lit(p) for p in HYGIENE_PATHS]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    text = F.when(F.col("l_linenumber") % 3 == 0, "audit=false").when(F.col("l_linenumber") % 3 == 1, "ignore-scripts=true").otherwise("")
    files = item.select(F.col("l_orderkey").alias("project"), path.alias("path"), text.alias("content"))
    return ad.hygiene_practices(manifests(_items(spark, sf)), files)


EVIDENCE = ["nuxt.config.ts", "vite.config.ts", "app.json", "metro.config.js", "src/routes/a.ts", "index.html", "src/App.vue", "pages/a.vue",
            "components/b.vue", "android/x.gradle", "ios/y.plist", "src/server.ts"]

_PATHS_SQL = f"paths AS (SELECT l_orderkey AS project, ([{', '.join(quoted(p) for p in EVIDENCE)}])[l_suppkey % 12 + 1] AS path FROM lineitem)"


def _paths(spark, sf):
    pick = F.element_at(F.array(*[F.lit(p) for p in EVIDENCE]), (F.col("l_suppkey") % 12 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project"), pick.alias("path"))


@query("P26 P27", f"""WITH {DEPS_SQL}, {_PATHS_SQL},
d AS (SELECT project, {', '.join(f"max(spec) FILTER (name = '{n}') AS {n.replace('-', '_')}" for n in ('nuxt', 'vue', 'expo', 'react-native', 'fastify', 'react'))}
  FROM spec WHERE section IN ('prod','dev') AND project IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY project),
hasm AS (SELECT DISTINCT project FROM spec WHERE project IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')),
e AS (SELECT project, bool_or(path = 'nuxt.config.ts') AS nc, bool_or(path = 'vite.config.ts') AS vc, bool_or(path = 'app.json') AS aj, bool_or(path = 'metro.config.js') AS mc, bool_or(starts_with(path, 'src/routes/') OR path = 'src/server.ts') AS fz,
  bool_or(starts_with(path, 'pages/')) AND bool_or(starts_with(path, 'components/')) AS nd, bool_or(path = 'src/App.vue') AS vf, bool_or(starts_with(path, 'android/')) AND bool_or(starts_with(path, 'ios/')) AS ai FROM paths GROUP BY project),
j AS (SELECT e.*, d.* EXCLUDE (project), h.project IS NOT NULL AS m, regexp_replace(nuxt, '[\\^~]', '') AS nv, regexp_replace(vue, '[\\^~]', '') AS vv FROM e LEFT JOIN d USING (project) LEFT JOIN hasm h USING (project))
SELECT project, CASE WHEN m THEN CASE WHEN starts_with(nv, '3.') THEN 'nuxt3' WHEN starts_with(vv, '3.') THEN 'vue3' WHEN expo IS NOT NULL THEN 'expo' WHEN react_native IS NOT NULL THEN 'react-native' WHEN fastify IS NOT NULL THEN 'fastify' WHEN react IS NOT NULL THEN 'react' ELSE 'node' END
  ELSE CASE WHEN nc AND nd THEN 'nuxt3' WHEN vc AND vf THEN 'vue3' WHEN mc OR ai THEN 'react-native' ELSE 'node' END END AS framework,
 CASE WHEN m THEN CASE WHEN starts_with(nv, '3.') THEN CASE WHEN nc THEN CAST(1.0 AS DOUBLE) ELSE 0.9 END WHEN starts_with(vv, '3.') THEN 0.95 WHEN expo IS NOT NULL THEN CASE WHEN aj THEN 1.0 ELSE 0.9 END WHEN react_native IS NOT NULL THEN CASE WHEN mc THEN 1.0 ELSE 0.9 END
   WHEN fastify IS NOT NULL THEN CASE WHEN fz THEN 0.95 ELSE 0.85 END WHEN react IS NOT NULL THEN 0.85 ELSE 0.5 END
  ELSE CASE WHEN nc AND nd THEN 0.8 WHEN vc AND vf THEN 0.75 WHEN mc OR ai THEN 0.7 ELSE 0.3 END END AS confidence FROM j""")
def project_frameworks(spark, sf):
    """Framework of every project: from the manifest, or from files where it is missing."""
    orders = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("project"))
    known = manifests(_items(spark, sf)).join(orders, "project", "left_semi")
    return ar.detect_framework(known, _paths(spark, sf)).select("project", "framework", "confidence")


@query("P28", f"""WITH {DEPS_SQL},
d AS (SELECT project, min(CASE name WHEN 'vitest' THEN 0 WHEN 'jest' THEN 1 WHEN '@playwright/test' THEN 2 WHEN 'mocha' THEN 3 WHEN 'ava' THEN 4 END) AS o FROM spec WHERE section IN ('prod','dev') GROUP BY project),
t AS (SELECT o_orderkey AS project, CASE o_orderstatus WHEN 'F' THEN 'vitest' WHEN 'O' THEN 'jest' END AS seen FROM orders)
SELECT project, coalesce((['vitest','jest','playwright','mocha','ava'])[o + 1], seen) AS test_framework FROM t FULL JOIN d USING (project)""")
def test_frameworks(spark, sf):
    """Test framework from the manifest, else from the text of the project's test file."""
    text = F.when(F.col("o_orderstatus") == "F", "import { it } from 'vitest'").when(F.col("o_orderstatus") == "O", "jest.mock('x')").otherwise("assert(1)")
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project"), F.lit("src/a.test.ts").alias("path"), text.alias("content"))
    return cv.test_framework(mf.read_manifests(manifests(_items(spark, sf))), files)
