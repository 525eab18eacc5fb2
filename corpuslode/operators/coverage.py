"""Coverage gaps: join, criticality, priority, reasons, summaries, test suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.paths import any_contains
from ..sources.coverage_reports import KINDS
from .ranking import PRIORITY_ORDER, ordered_rank, rank_of, top_k

# Default thresholds.
THRESHOLDS = {"lines": 80.0, "functions": 80.0, "branches": 75.0, "statements": 80.0}


def importer_counts(files: DataFrame, imports: DataFrame) -> DataFrame:
    """How many other files of the project import a module of this file's name.

    Names are counted before they meet the files, so a name that half of the
    project imports is one row on each side of the join.
    """
    name = paths.basename(F.regexp_replace("source", r"\.(?:tsx?|jsx?|vue)$", ""))
    pairs = imports.select("project", "path", name.alias("name")).distinct()
    counts = pairs.groupBy("project", "name").agg(F.count(F.lit(1)).alias("importers"))
    named = files.select("project", "path", paths.stem(F.col("path")).alias("name"))
    own = pairs.withColumn("own", F.lit(1))
    return (
        named.join(counts, ["project", "name"], "left")
        .join(own, ["project", "path", "name"], "left")
        .select("project", "path", (F.coalesce("importers", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("importers"))
    )


def criticality(path: Column, importers: Column) -> Column:
    """Path class first; then five importers make a file core, three important."""
    low = F.lower(path)
    return (
        F.when(any_contains(low, paths.CORE_DIRS), F.lit("core"))
        .when(any_contains(low, paths.IMPORTANT_DIRS), F.lit("important"))
        .when(importers >= 5, F.lit("core"))
        .when(importers >= 3, F.lit("important"))
        .when(any_contains(low, paths.STANDARD_DIRS), F.lit("standard"))
        .otherwise(F.lit("peripheral"))
    )


def is_gap(thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """No coverage at all, or any kind below its threshold."""
    below = F.col("lines_total").isNull()
    for kind, least in thresholds.items():
        below = below | F.coalesce(F.col(f"{kind}_pct") < least, F.lit(False))
    return below


def gap_priority(lines: Column, critical: Column, cx: Column, least: float) -> Column:
    core, important, standard = critical == "core", critical == "important", critical == "standard"
    return (
        F.when(core & (lines == 0) & (cx > 30), "critical")
        .when(core & (lines < least), "critical")
        .when(important & ((lines == 0) | (lines < least)), "high")
        .when((cx > 50) & (lines < 50), "high")
        .when(standard & (lines < least), "medium")
        .otherwise("low")
    )


def gap_reasons(thresholds: dict[str, float] = THRESHOLDS) -> Column:
    lines, functions = F.coalesce("lines_pct", F.lit(0.0)), F.col("functions_pct")
    critical, cx = F.col("criticality"), F.col("complexity")
    covered = lines > 0
    one = lambda x: F.format_string("%.1f", x)
    return F.array_compact(F.array(
        F.when(~covered, F.lit("No test coverage")),
        F.when(covered & (lines < thresholds["lines"]),
               F.concat(F.lit("Line coverage "), one(lines), F.lit(f"% below threshold {thresholds['lines']:g}%"))),
        F.when(covered & (functions < thresholds["functions"]),
               F.concat(F.lit("Function coverage "), one(functions), F.lit(f"% below threshold {thresholds['functions']:g}%"))),
        F.when(critical == "core", F.lit("Core utility - high impact if bugs present")),
        F.when(critical == "important", F.lit("Important file - widely used across codebase")),
        F.when(cx > 50, F.concat(F.lit("High complexity ("), cx.cast("string"), F.lit(") - error-prone")))
        .when(cx > 30, F.concat(F.lit("Moderate complexity ("), cx.cast("string"), F.lit(") - needs testing"))),
    ))


def coverage_gaps(facts: DataFrame, coverage: DataFrame, importers: DataFrame,
                  thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Gap rows for files that have no coverage or too little of it."""
    joined = facts.join(coverage, ["project", "path"], "left").join(importers, ["project", "path"], "left")
    joined = joined.withColumn("criticality", criticality(F.col("path"), F.coalesce("importers", F.lit(0))))
    gaps = joined.filter(is_gap(thresholds))
    lines = F.coalesce("lines_pct", F.lit(0.0))
    no_functions = F.col("functions_pct").isNull() | (F.col("functions_pct") == 0)
    return (
        gaps.withColumn("priority", gap_priority(lines, F.col("criticality"), F.col("complexity"), thresholds["lines"]))
        .withColumn("reasons", gap_reasons(thresholds))
        .withColumn("untested_functions", F.when(no_functions, F.col("exports")).otherwise(F.col("uncovered_functions")))
        .withColumn("untested_lines", F.coalesce("uncovered_lines", F.array().cast("array<bigint>")))
        .na.fill(0.0, [f"{k}_pct" for k in KINDS])
    )


def overall_coverage(coverage: DataFrame) -> DataFrame:
    """Weighted coverage per project and kind, not a mean of percentages."""
    def share(kind):
        total, covered = F.sum(f"{kind}_total"), F.sum(f"{kind}_covered")
        return F.when(total > 0, covered / total * 100).otherwise(0.0).alias(f"{kind}_pct")

    return coverage.groupBy("project").agg(*[share(k) for k in KINDS])


def gap_summary(files: DataFrame, gaps: DataFrame) -> DataFrame:
    lines = F.col("lines_pct")
    counted = gaps.groupBy("project").agg(
        F.count(F.lit(1)).alias("gaps"),
        F.count_if(lines == 0).alias("untested"),
        F.count_if((lines > 0) & (lines < 100)).alias("partially_tested"),
        F.count_if(F.col("priority").isin("critical", "high")).alias("urgent"),
    )
    sizes = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"))
    joined = sizes.join(counted, "project", "left").na.fill(0)
    return joined.withColumn("tested", F.col("files") - F.col("gaps"))


def critical_gaps(gaps: DataFrame, limit: int | None = None) -> DataFrame:
    """Critical and high gaps, ranked within their project; ``limit`` ends the list."""
    urgent = gaps.filter(F.col("priority").isin("critical", "high")).withColumn("_p", rank_of(F.col("priority"), PRIORITY_ORDER))
    if limit is not None:
        return top_k(urgent, ["project"], [F.col("_p"), F.desc("complexity"), F.col("path")], limit).withColumn("rank", F.col("rank").cast("bigint")).drop("_p")
    return ordered_rank(urgent.withColumn("_c", -F.col("complexity")), ["project"], ["_p", "_c", "path"]).drop("_p", "_c")


MOBILE, VUE = ("react-native", "expo"), ("vue3", "nuxt3")


def suggest_tests(gaps: DataFrame) -> DataFrame:
    """Kind of test, where it goes, and the effort, for each gap."""
    path, framework = F.col("path"), F.col("framework")
    ext, name = paths.extname(path), paths.basename(path)
    component = ext.isin(".tsx", ".jsx", ".vue")
    mobile, vue = framework.isin(*MOBILE), framework.isin(*VUE)
    screen = path.contains("screens") | (path.contains("app/") & mobile)
    hook = name.startswith("use") & any_contains(path, ["hooks", "composables"])
    store = any_contains(path, ["/stores/", "/store/"])
    route = path.contains("/server/") & any_contains(path, ["/api/", "/routes/"])
    util = any_contains(path, ["utils", "lib", "helpers"])
    kind = (
        F.when((component | screen) & mobile, "mobile-component")
        .when(hook & mobile, "mobile-hook")
        .when(component & (framework == "react"), "component")
        .when(hook & (framework == "react"), "hook")
        .when(store & vue, "store")
        .when(route & (framework == "nuxt3"), "server-route")
        .when(component & vue, "vue-component")
        .when(hook & vue, "composable")
        .when(util, "utility")
        .otherwise("unit")
    )
    cx = F.col("complexity")
    effort = F.when((F.col("test_kind") == "utility") & (F.size("untested_functions") > 5), "high").when(cx > 50, "high").when(cx > 30, "medium").otherwise("low")
    test_path = F.regexp_replace(path, r"(\.[^./]+)$", ".test$1")
    return gaps.withColumn("test_kind", kind).withColumn("test_path", test_path).withColumn("effort", effort)


# Test frameworks in priority order and the packages that show them.
TEST_FRAMEWORKS = [
    ("vitest", ["vitest"]), ("jest", ["jest", "@jest/core"]), ("playwright", ["@playwright/test"]), ("mocha", ["mocha"]), ("ava", ["ava"]),
]


def test_framework(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Test framework per project: from the manifest, else from its first test file."""
    name = F.col("name")
    order = F.lit(None).cast("int")
    for i, (_, packages) in reversed(list(enumerate(TEST_FRAMEWORKS))):
        order = F.when(name.isin(*packages), i).otherwise(order)
    declared = dependencies.filter(~F.col("is_peer") & ~F.col("is_optional")).groupBy("project").agg(F.min(order).alias("o"))
    names = F.array(*[F.lit(n) for n, _ in TEST_FRAMEWORKS])
    declared = declared.select("project", F.when(F.col("o").isNotNull(), F.element_at(names, F.col("o") + 1)).alias("declared"))
    tests = files.filter(paths.glob_match(F.col("path"), paths.TEST_GLOBS[:2]))
    text = F.col("content")
    seen = (
        F.when(any_contains(text, ["import { describe, it", "from 'vitest'"]), "vitest")
        .when(any_contains(text, ["from '@jest/globals'", "jest."]), "jest")
        .when(text.contains("@playwright/test"), "playwright")
    )
    first = tests.groupBy("project").agg(F.min_by(seen, "path").alias("seen"))
    projects = declared.select("project").union(files.select("project")).distinct()
    return projects.join(declared, "project", "left").join(first, "project", "left").select(
        "project", F.coalesce("declared", "seen").alias("test_framework")
    )


def test_profile(files: DataFrame, n: int = 5) -> DataFrame:
    """What the first test files of each project use; the last of them decides single values."""
    tests = files.filter(paths.glob_match(F.col("path"), paths.TEST_GLOBS))
    text = F.col("content")
    rows = tests.select(
        "project", "path",
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"""import\s+.*\s+from\s+['"].+['"]"""), F.lit(0))).alias("imports"),
        F.when(any_contains(text, ["vi.mock", "vitest"]), "vi.mock").when(text.contains("jest.mock"), "jest.mock").alias("mock"),
        F.when(text.contains("render("), "render").when(text.contains("mount("), "mount").alias("render"),
        F.when(text.contains("expect("), "expect").when(text.contains("assert."), "assert").alias("assertion"),
        F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in ("beforeEach", "afterEach", "beforeAll")])).alias("setup"),
    )
    first = top_k(rows, ["project"], [F.col("path")], n)

    def last(column):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("rank")))

    return first.groupBy("project").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("imports")))).alias("import_statements"),
        last("mock").alias("mocking_library"),
        last("render").alias("render_function"),
        F.coalesce(last("assertion"), F.lit("expect")).alias("assertion_library"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("setup")))).alias("setup_patterns"),
        F.count(F.lit(1)).alias("example_files"),
    )
