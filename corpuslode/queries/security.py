"""Security queries: rule families, findings, summaries, score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as fd, ranking as rk
from ..operators.scan import findings, scan
from ..rules import FAMILIES, FAMILY_ORDER, PRACTICES, security_rules
from ..session import cut
from .corpus import code_files, corpus_ctes, quoted, table, text_table
from .registry import REGISTRY, Query, query
from .rule_sql import rules_values, scan_sql

RULES = security_rules()
AWS_RULE = [r for r in FAMILIES["crypto"] if "AWS Secret" in r.title]


def _all_findings(spark, sf):
    return findings(code_files(spark, sf), RULES)


def _unique(spark, sf):
    return fd.dedupe_findings(_all_findings(spark, sf))


def _stored(spark, sf):
    """Findings that are read more than once are written once; the corpus is scanned once."""
    return cut(_unique(spark, sf))


def _practices(spark, sf):
    return fd.dedupe_practices(findings(code_files(spark, sf), PRACTICES))


def ranks_sql(order, column) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {quoted(v)} THEN {i}" for i, v in enumerate(order)) + f" ELSE {len(order)} END"


def unique_ctes() -> str:
    """``found``: deduplicated findings with rule columns."""
    return f"""{corpus_ctes('imports')},
{rules_values(RULES)},
hits AS MATERIALIZED ({scan_sql(RULES)}),
found AS MATERIALIZED (
  SELECT * EXCLUDE (pick) FROM (
    SELECT h.*, r.* EXCLUDE (rule_id), row_number() OVER (PARTITION BY project, path, line, title
      ORDER BY {ranks_sql(FAMILY_ORDER, 'family')}, CAST(regexp_extract(h.rule_id, '(\\d+)$', 1) AS INT)) AS pick
    FROM hits h JOIN rules r USING (rule_id)) WHERE pick = 1)"""


def practice_ctes() -> str:
    return f"""{rules_values(PRACTICES, 'practice_rules')},
good AS MATERIALIZED (
  SELECT project, path, title, min_by(category, CAST(regexp_extract(rule_id, '(\\d+)$', 1) AS INT)) AS category,
         min_by(rule_id, CAST(regexp_extract(rule_id, '(\\d+)$', 1) AS INT)) AS rule_id
  FROM ({scan_sql(PRACTICES)}) JOIN practice_rules USING (rule_id) GROUP BY project, path, title)"""


def _register_family(name, rules):
    """Raw hits of one family: rule, line, judged value and snippet."""

    def run(spark, sf):
        return scan(code_files(spark, sf), rules).select("project", "path", "rule_id", "line", "value", "snippet")

    def sql():
        return (f"WITH {corpus_ctes('imports')} SELECT project, path, rule_id, CAST(line AS INT) AS line, value, snippet "
                f"FROM ({scan_sql(rules)})")

    REGISTRY[f"scan_{name}"] = Query(f"scan_{name}", "R1 R2 R3 R4 R5 F6 F7 F8 F9 F10 F12 P18 P19", run, sql)


for _name, _rules in FAMILIES.items():
    _register_family(_name, _rules)
_register_family("practices", PRACTICES)


@query("R1 P18 U2 A1 A5 A6", lambda: f"""
WITH raw AS (SELECT doc_id, source, text, regexp_extract_all(text, {quoted(AWS_RULE[0].pattern)}, 1) AS vs,
                    string_split_regex(text, {quoted(AWS_RULE[0].pattern)}) AS gaps,
                    regexp_extract_all(text, {quoted(AWS_RULE[0].pattern)}, 0) AS ms FROM documents),
rows AS (SELECT source, doc_id, vs[i] AS v,
           len(string_split(array_to_string(gaps[1:i], '') || array_to_string(ms[1:i-1], ''), chr(10))) AS line
         FROM (SELECT *, unnest(generate_series(1, len(vs))) AS i FROM raw)),
bad AS (SELECT DISTINCT source, doc_id, line FROM rows
        WHERE NOT regexp_matches(v, '^[A-Za-z_]+$')
          AND NOT (contains(v, 'xxx') OR contains(v, 'XXX') OR contains(v, 'your-') OR contains(v, 'YOUR_')
                   OR contains(v, 'example') OR contains(v, 'placeholder'))),
n AS (SELECT source, count(*) AS files FROM documents GROUP BY source),
s AS (SELECT n.source AS project, files, count(bad.doc_id) AS high,
             greatest(0, least(100, 100 - 8 * count(bad.doc_id) + CASE WHEN files > 100 THEN 5 ELSE 0 END)) AS score
      FROM n LEFT JOIN bad USING (source) GROUP BY n.source, files)
SELECT project, files, high, CAST(score AS INT) AS score,
       CASE WHEN score < 20 THEN 'critical' WHEN score < 40 THEN 'high' WHEN score < 60 THEN 'moderate'
            WHEN score < 80 THEN 'low' ELSE 'minimal' END AS risk FROM s""")
def document_secret_scores(spark, sf):
    """The raw documents as files of projects: secrets, score and risk per source."""
    files = text_table(spark, sf, "documents").select(
        F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"),
        F.col("text").alias("content"), F.lit("node").alias("framework"),
    )
    bad = fd.dedupe_findings(findings(files, AWS_RULE))
    none = bad.filter(F.lit(False))
    return fd.security_score(bad, none, files).select("project", "files", "high", "score", "risk")


@query("U1 U2 W17", lambda: f"""WITH {unique_ctes()}
SELECT project, path, CAST(line AS INT) AS line, title, rule_id, family, category, severity, status, confidence, auto_fixable
FROM found""")
def unique_findings(spark, sf):
    return _unique(spark, sf).select("project", "path", "line", "title", "rule_id", "family", "category", "severity",
                                     "status", "confidence", "auto_fixable")


@query("U3", lambda: f"WITH {corpus_ctes('imports')}, {practice_ctes()} SELECT project, path, title, category, rule_id FROM good")
def unique_practices(spark, sf):
    return _practices(spark, sf)


@query("A1 A2 A3", lambda: f"""WITH {unique_ctes()}
SELECT project, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in rk.SEVERITY_ORDER)}, count(*) AS total,
 count(*) FILTER (category = 'injection') AS injection,
 count(*) FILTER (category IN ('crypto', 'cryptographic_failures')) AS crypto,
 count(*) FILTER (category = 'access_control') AS access_control,
 count(*) FILTER (category IN ('misconfiguration', 'security_misconfiguration')) AS misconfiguration,
 count(*) FILTER (category = 'mobile') AS mobile, count(*) FILTER (category = 'vue_nuxt') AS vue_nuxt,
 count(*) FILTER (category IN ('fastify_backend', 'input_validation')) AS fastify_backend,
 count(*) FILTER (category = 'data_exposure') AS data_exposure, count(*) FILTER (category = 'dependencies') AS dependencies,
 count(*) FILTER (status = 'needs_fix') AS needs_fix, count(*) FILTER (status = 'review') AS review,
 count(*) FILTER (status = 'acceptable') AS acceptable
FROM found GROUP BY project""")
def security_summaries(spark, sf):
    """Severity, category and status counts from one aggregation of the findings."""
    return fd.summaries(_unique(spark, sf))


@query("A4", lambda: f"""WITH {unique_ctes()},
f AS (SELECT severity, CASE category WHEN 'cryptographic_failures' THEN 'crypto' WHEN 'security_misconfiguration' THEN 'misconfiguration'
        WHEN 'input_validation' THEN 'fastify_backend' ELSE category END AS category FROM found)
SELECT severity, category, count(*) AS findings, CAST(grouping(severity, category) AS INT) AS level
FROM f GROUP BY GROUPING SETS ((severity, category), (severity), (category), ())""")
def severity_category_rollup(spark, sf):
    return fd.severity_by_category(_unique(spark, sf))


@query("A5 A6 J14 F12", lambda: f"""WITH {unique_ctes()}, {practice_ctes()},
n AS (SELECT project, count(*) AS files FROM code_files GROUP BY project),
b AS (SELECT project, count(*) FILTER (severity='critical') AS c, count(*) FILTER (severity='high') AS h,
             count(*) FILTER (severity='medium') AS m, count(*) FILTER (severity='low') AS l FROM found GROUP BY project),
g AS (SELECT project, count(*) AS p FROM good GROUP BY project),
s AS (SELECT project, files, coalesce(p, 0) AS positives,
        greatest(0, least(100, 100 - 15*coalesce(c,0) - 8*coalesce(h,0) - 4*coalesce(m,0) - coalesce(l,0)
          + least(10, 2*coalesce(p,0)) + CASE WHEN files > 100 THEN 5 ELSE 0 END)) AS score
      FROM n LEFT JOIN b USING (project) LEFT JOIN g USING (project))
SELECT project, files, positives, CAST(score AS INT) AS score,
  CASE WHEN score < 20 THEN 'critical' WHEN score < 40 THEN 'high' WHEN score < 60 THEN 'moderate' WHEN score < 80 THEN 'low' ELSE 'minimal' END AS risk
FROM s""")
def security_scores(spark, sf):
    files = code_files(spark, sf)
    bad, good = fd.split_hits(cut(findings(files, [*RULES, *PRACTICES])))  # one scan
    return fd.security_score(bad, good, files).select("project", "files", "positives", "score", "risk")


@query("F1 F2 W1 W9", lambda: f"""WITH {unique_ctes()},
k AS (SELECT *, count(*) OVER (PARTITION BY project) AS total_items,
        row_number() OVER (PARTITION BY project ORDER BY {ranks_sql(rk.SEVERITY_ORDER, 'severity')}, path, line, title) AS rank
      FROM found WHERE severity IN ('critical','high','medium') AND category IN ('injection','crypto','access_control','misconfiguration'))
SELECT project, path, CAST(line AS INT) AS line, title, severity, CAST(rank AS INT) AS rank, total_items,
       CAST(ceil(total_items / 20.0) AS INT) AS total_pages, 2 < ceil(total_items / 20.0) AS has_next
FROM k WHERE rank > 20 AND rank <= 40""")
def security_page(spark, sf):
    """Second page of 20 after severity and category filters, in severity order."""
    kept = fd.keep_listed(_stored(spark, sf), "severity", ["critical", "high", "medium"])
    kept = fd.keep_listed(kept, "category", ["injection", "crypto", "access_control", "misconfiguration"])
    kept = kept.withColumn("severity_rank", rk.rank_of(F.col("severity"), rk.SEVERITY_ORDER))
    page = rk.paged(kept, ["project"], ["severity_rank", "path", "line", "title"], page=2, size=20, clamp=False)
    return page.select("project", "path", "line", "title", "severity", "rank", "total_items", "total_pages", "has_next")


@query("W17", lambda: f"""WITH {unique_ctes()},
k AS (SELECT *, row_number() OVER (PARTITION BY project, family ORDER BY path, line, title, rule_id) AS n FROM found)
SELECT project, path, CAST(line AS INT) AS line, title,
  regexp_extract(rule_id, '^([A-Z]+)', 1) || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS finding_id,
  sha256(path || ':' || line || ':' || title) AS stable_id FROM k""")
def finding_ids(spark, sf):
    return fd.numbered_findings(_unique(spark, sf)).select("project", "path", "line", "title", "finding_id", "stable_id")


@query("W12", lambda: f"""WITH {unique_ctes()},
k AS (SELECT project, path, line, title, {ranks_sql(rk.SEVERITY_ORDER, 'severity')} AS sr,
        greatest(1, CAST(ceil(length(title || path || substring(snippet, 1, 100)) / 4) AS BIGINT)) AS tokens FROM found),
r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER (PARTITION BY project ORDER BY sr, path, line, title ROWS UNBOUNDED PRECEDING) AS running_tokens
      FROM k WINDOW w AS (PARTITION BY project ORDER BY sr, path, line, title))
SELECT project, path, CAST(line AS INT) AS line, title, CAST(rank AS INT) AS rank, CAST(running_tokens AS BIGINT) AS running_tokens
FROM r WHERE running_tokens <= 2000""")
def size_budgeted_findings(spark, sf):
    """Longest prefix of each project's findings that fits a token limit, snippets cut to 100."""
    found = _unique(spark, sf).withColumn("severity_rank", rk.rank_of(F.col("severity"), rk.SEVERITY_ORDER))
    cost = F.ceil(F.length(F.concat("title", "path", F.substring("snippet", 1, 100))) / 4)
    fit = rk.fitting_prefix(found.withColumn("tokens", cost), ["project"], ["severity_rank", "path", "line", "title"],
                            "tokens", limit=2000)
    return fit.select("project", "path", "line", "title", "rank", "running_tokens")


@query("A31 U4", lambda: f"""WITH {unique_ctes()},
m AS (SELECT project, path, line, title, rule_id, unnest(list_filter([
   CASE WHEN severity='critical' THEN 'critical' END, CASE WHEN severity='high' THEN 'high' END,
   CASE WHEN contains(lower(title),'hardcoded') OR contains(lower(title),'secret') THEN 'secrets' END,
   CASE WHEN category='injection' THEN 'injection' END, CASE WHEN category='access_control' THEN 'access_control' END,
   CASE WHEN severity='medium' THEN 'medium' END, 'review_process'], lambda x: x IS NOT NULL)) AS recommendation FROM found),
g AS (SELECT project, recommendation, count(*) AS findings, count(DISTINCT path) AS affected_files FROM m GROUP BY ALL),
t AS (SELECT project, recommendation, string_agg(title, ', ' ORDER BY rn) AS first_titles
      FROM (SELECT *, row_number() OVER (PARTITION BY project, recommendation ORDER BY path, line, title, rule_id) AS rn FROM m) WHERE rn <= 3 GROUP BY ALL),
p(recommendation, priority, effort, impact, least) AS (VALUES {', '.join(str(r) for r in fd.RECOMMENDATIONS)})
SELECT project, recommendation, priority, effort, impact, findings, affected_files, first_titles
FROM g JOIN t USING (project, recommendation) JOIN p USING (recommendation) WHERE findings >= least""")
def security_recommendations(spark, sf):
    return fd.recommendations(_stored(spark, sf))


@query("J13", lambda: f"""WITH {unique_ctes()},
a AS (SELECT project, path, line, title, min(severity) AS sa FROM found f JOIN code_files USING (project, path)
      WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = code_files.doc_id AND l.toxic = 1) GROUP BY ALL),
b AS (SELECT project, path, line, title, min(severity) AS sb FROM found f JOIN code_files USING (project, path)
      WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = code_files.doc_id AND l.quality = 0) GROUP BY ALL)
SELECT project, path, CAST(line AS INT) AS line, title, sa AS severity_before, sb AS severity_after,
  CASE WHEN sa IS NULL THEN 'new' WHEN sb IS NULL THEN 'fixed' ELSE 'persisting' END AS state
FROM a FULL JOIN b USING (project, path, line, title)""")
def finding_snapshot_diff(spark, sf):
    """Two runs over corpora that differ by labelled documents: new, fixed, persisting."""
    found = _stored(spark, sf)
    docs = code_files(spark, sf).select("project", "path", "doc_id")
    labels = table(spark, sf, "labels")
    before = docs.join(labels.filter("toxic = 1"), "doc_id", "left_anti")
    after = docs.join(labels.filter("quality = 0"), "doc_id", "left_anti")
    return fd.snapshot_diff(found.join(before, ["project", "path"], "left_semi"),
                            found.join(after, ["project", "path"], "left_semi"))
