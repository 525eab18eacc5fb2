"""Findings: deduplicate, filter, summarise, score and recommend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import FAMILY_ORDER
from .ranking import SEVERITY_ORDER, ordered_rank, rank_of, top_k

# Category names that are counted under another name.
FOLDED = {
    "cryptographic_failures": "crypto",
    "security_misconfiguration": "misconfiguration",
    "input_validation": "fastify_backend",
}
CATEGORIES = [
    "injection", "crypto", "access_control", "misconfiguration", "mobile", "vue_nuxt", "fastify_backend",
    "data_exposure", "dependencies",
]
STATUSES = ["needs_fix", "review", "acceptable"]

# Score weights and risk bands.
WEIGHTS = {"critical": 15, "high": 8, "medium": 4, "low": 1}
RISK_BANDS = [(20, "critical"), (40, "high"), (60, "moderate"), (80, "low")]

FINDING_KEY = ["project", "path", "line", "title"]


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per place and title; the first family in order wins.

    A minimum over structs combines on the map side, so copies of a finding
    never travel and a hot key is no heavier than any other.
    """
    rest = [c for c in findings.columns if c not in FINDING_KEY]
    ranked = findings.withColumn("_family", rank_of(F.col("family"), FAMILY_ORDER)).withColumn(
        "_number", F.regexp_extract("rule_id", r"(\d+)$", 1).cast("int")
    )
    best = F.min(F.struct("_family", "_number", *rest)).alias("_best")
    return ranked.groupBy(*FINDING_KEY).agg(best).select(*FINDING_KEY, *[F.col(f"_best.{c}").alias(c) for c in rest])


def split_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and practices of one scan with rules of both kinds, each deduplicated."""
    return dedupe_findings(hits.filter("polarity = 'bad'")), dedupe_practices(hits.filter("polarity = 'good'"))


def dedupe_practices(practices: DataFrame) -> DataFrame:
    """One practice per file and title."""
    best = F.min(F.struct("_number", "category", "rule_id")).alias("_best")
    return (
        practices.withColumn("_number", F.regexp_extract("rule_id", r"(\d+)$", 1).cast("int"))
        .groupBy("project", "path", "title").agg(best)
        .select("project", "path", "title", F.col("_best.category").alias("category"), F.col("_best.rule_id").alias("rule_id"))
    )


def keep_listed(df: DataFrame, column: str, wanted: Sequence[str] | None) -> DataFrame:
    """IN-list filter; an empty list keeps everything."""
    return df.filter(F.col(column).isin(*wanted)) if wanted else df


def folded_category(category: Column) -> Column:
    out = category
    for name, target in FOLDED.items():
        out = F.when(category == name, F.lit(target)).otherwise(out)
    return out


def _counts(column: Column, values: Sequence[str]) -> list[Column]:
    return [F.count_if(column == v).alias(v) for v in values]


def severity_summary(findings: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    return findings.groupBy(*keys).agg(*_counts(F.col("severity"), SEVERITY_ORDER), F.count(F.lit(1)).alias("total"))


def category_summary(findings: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    return findings.groupBy(*keys).agg(*_counts(folded_category(F.col("category")), CATEGORIES))


def status_summary(findings: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    return findings.groupBy(*keys).agg(*_counts(F.col("status"), STATUSES))


def summaries(findings: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Severity, category and status counts from one pass over the findings."""
    return findings.groupBy(*keys).agg(
        *_counts(F.col("severity"), SEVERITY_ORDER),
        F.count(F.lit(1)).alias("total"),
        *_counts(folded_category(F.col("category")), CATEGORIES),
        *_counts(F.col("status"), STATUSES),
    )


def severity_by_category(findings: DataFrame) -> DataFrame:
    """Both summaries at once: counts for severity, category, both, and all."""
    return (
        findings.withColumn("category", folded_category(F.col("category")))
        .groupingSets([["severity", "category"], ["severity"], ["category"], []], "severity", "category")
        .agg(F.count(F.lit(1)).alias("findings"), F.grouping_id().cast("int").alias("level"))
    )


def security_score(findings: DataFrame, practices: DataFrame, files: DataFrame, large_bonus: int = 5) -> DataFrame:
    """Score 0-100 and risk level per project; projects without findings score too.

    ``large_bonus`` is added for projects with more than 100 files; 0 leaves size out of the score.
    """
    bad = severity_summary(findings)
    good = practices.groupBy("project").agg(F.count(F.lit(1)).alias("positives"))
    size = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"))
    joined = size.join(bad, "project", "left").join(good, "project", "left").na.fill(0)
    score = F.lit(100) - sum(F.col(s) * w for s, w in WEIGHTS.items())
    score = score + F.least(F.lit(10), F.col("positives") * 2) + F.when(F.col("files") > 100, large_bonus).otherwise(0)
    return joined.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")).withColumn(
        "risk", risk_level(F.col("score"))
    )


def risk_level(score: Column) -> Column:
    out = F.when(score < RISK_BANDS[0][0], F.lit(RISK_BANDS[0][1]))
    for bound, name in RISK_BANDS[1:]:
        out = out.when(score < bound, F.lit(name))
    return out.otherwise(F.lit("minimal"))


def corpus_metrics(facts: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Files, lines, security-related files and complexity figures."""
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("lines").alias("lines"),
        F.count_if("security_related").alias("security_files"),
        F.avg("complexity").alias("avg_complexity"),
        F.max("complexity").alias("max_complexity"),
        F.count_if(F.col("complexity") > 20).alias("complex_files"),
    )


def numbered_findings(findings: DataFrame) -> DataFrame:
    """Sequential ids per project and family in path order, and a stable hash id."""
    ordered = ordered_rank(findings, ["project", "family"], ["path", "line", "title", "rule_id"], "number")
    prefix = F.regexp_extract("rule_id", r"^([A-Z]+)", 1)
    digits = F.col("number").cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    key = F.concat_ws(":", F.col("path"), F.col("line").cast("string"), F.col("title"))
    return ordered.withColumn("finding_id", F.concat_ws("-", prefix, padded)).withColumn("stable_id", F.sha2(key, 256))


# Recommendation groups (key, priority, effort, impact, least findings).
RECOMMENDATIONS = [
    ("critical", "immediate", "medium", "high", 1),
    ("high", "high", "medium", "high", 1),
    ("secrets", "immediate", "low", "high", 1),
    ("injection", "high", "medium", "high", 1),
    ("access_control", "high", "medium", "high", 1),
    ("medium", "medium", "medium", "medium", 6),
    ("review_process", "medium", "medium", "high", 1),
]


def recommendation_members(findings: DataFrame) -> DataFrame:
    """Which recommendation groups each finding supports, one row per pair."""
    title = F.lower("title")
    member = F.array_compact(F.array(
        F.when(F.col("severity") == "critical", F.lit("critical")),
        F.when(F.col("severity") == "high", F.lit("high")),
        F.when(title.contains("hardcoded") | title.contains("secret"), F.lit("secrets")),
        F.when(F.col("category") == "injection", F.lit("injection")),
        F.when(F.col("category") == "access_control", F.lit("access_control")),
        F.when(F.col("severity") == "medium", F.lit("medium")),
        F.lit("review_process"),
    ))
    return findings.withColumn("recommendation", F.explode(member))


def recommendations(findings: DataFrame) -> DataFrame:
    """Evidence per project and group: findings, distinct files, first titles.

    The files themselves stay in long form (``recommendation_members``); only
    bounded lists are packed into rows.
    """
    members = recommendation_members(findings)
    keys = ["project", "recommendation"]
    counted = members.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("affected_files"))
    first = top_k(members, keys, [F.col(c) for c in ("path", "line", "title", "rule_id")], 3)
    titles = first.groupBy(*keys).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), ", ").alias("first_titles"))
    table = findings.sparkSession.createDataFrame(
        RECOMMENDATIONS, "recommendation string, priority string, effort string, impact string, least int"
    )
    return (
        totals.join(F.broadcast(table), "recommendation").filter(F.col("findings") >= F.col("least")).drop("least")
        .join(titles, keys)
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """State of every finding between two runs: new, fixed or persisting."""
    def keyed(df, name):
        return df.groupBy("project", "path", "line", "title").agg(F.min("severity").alias(name))

    both = keyed(before, "severity_before").join(keyed(after, "severity_after"), FINDING_KEY, "full_outer")
    state = (
        F.when(F.col("severity_before").isNull(), "new").when(F.col("severity_after").isNull(), "fixed").otherwise("persisting")
    )
    return both.withColumn("state", state)
