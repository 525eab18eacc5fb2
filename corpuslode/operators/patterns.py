"""Pattern occurrences: located constructs, their attributes, and project summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import PATTERNS
from ..rules.access import with_property
from ..rules.patterns import (
    QUERY_WORDS, ROUTE_HOOKS, STREAM_OPERATORS, STREAM_SOURCES, STREAM_STORES, STREAM_WINDOWS,
)
from .ranking import top_k
from .scan import findings


def occurrences(files: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """One row per construct: type, name, line, confidence, and the matched text."""
    rules = [r for r in PATTERNS if kinds is None or r.kind in kinds]
    found = findings(files, rules)
    return found.select("project", "path", "framework", "line", F.col("kind").alias("type"), F.coalesce("name", "value").alias("name"),
                        "confidence", "rule_id", "matched")


def routes(found: DataFrame) -> DataFrame:
    """Method, path and whether the options name a schema or hooks."""
    text = F.col("matched")
    wide = F.col("name") == "route"
    url = F.regexp_extract(text, r"""\burl\s*:\s*['"]([^'"\n]*)['"]""", 1)
    verb = F.regexp_extract(text, r"""\bmethod\s*:\s*['"](\w+)['"]""", 1)
    path = F.regexp_extract(text, r"""^[^'"`]*['"`]([^'"`\n]*)""", 1)
    method = F.upper(F.when(wide, F.when(verb == "", "GET").otherwise(verb)).otherwise(F.col("name")))
    target = F.when(wide, F.when(url == "", "unknown").otherwise(url)).otherwise(path)
    return found.filter(F.col("type") == "fastify-routes").select(
        "project", "path", "line", method.alias("method"), target.alias("route"), text.rlike(with_property(["schema"])).alias("has_schema"),
        text.rlike(with_property(ROUTE_HOOKS)).alias("has_hooks"))


def query_type(text: Column) -> Column:
    """First keyword of the list that the query holds."""
    upper, out = F.upper(text), F.lit("other")
    for word in reversed(QUERY_WORDS):
        out = F.when(upper.contains(word), word).otherwise(out)
    return out


def queries(found: DataFrame) -> DataFrame:
    """Statement type and parameter use of literal queries."""
    text = F.col("matched")
    literal = text.rlike(r"""\(\s*['"`]""")
    body = F.regexp_replace(text, r"\$\{[^}]*\}", " ")
    return found.filter(F.col("type") == "postgres-queries").select(
        "project", "path", "line", F.when(literal, query_type(body)).otherwise("other").alias("query_type"),
        (literal & (body.rlike(r"\$\d+") | text.rlike(r",$"))).alias("parameterized"))


def _names(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def messaging(found: DataFrame) -> DataFrame:
    """Producers and consumers with their topics."""
    text = F.col("matched")
    one = _names(text, r"""\btopics?\s*:\s*['"]([^'"\n]+)['"]""")
    many = _names(F.regexp_extract(text, r"\btopics\s*:\s*\[([^\]]*)\]", 1), r"""['"]([^'"\n]+)['"]""")
    return found.filter(F.col("type").isin("kafka-producers", "kafka-consumers")).select(
        "project", "path", "line", "type", "name", F.concat(one, many).alias("topics"))


def stream_tasks(found: DataFrame) -> DataFrame:
    """Source, operators, windows and storage of task chains; chains without operators are left out."""
    calls = _names(F.col("matched"), r"\.(\w+)\s*\(")
    wanted = F.array(*[F.lit(n) for n in [*STREAM_OPERATORS, *STREAM_WINDOWS]])
    has = lambda names: F.arrays_overlap("calls", F.array(*[F.lit(n) for n in names]))
    source = F.lit("custom")
    for call, name in reversed(STREAM_SOURCES):
        source = F.when(F.array_contains("calls", call), name).otherwise(source)
    rows = found.filter(F.col("type") == "stream-tasks").withColumn("calls", calls)
    rows = rows.withColumn("operators", F.filter("calls", lambda c: F.array_contains(wanted, c)))
    return rows.filter(F.size("operators") > 0).select(
        "project", "path", "line", source.alias("source"), "operators", has(STREAM_WINDOWS).alias("windowed"), has(STREAM_STORES).alias("stored"))


def stores(found: DataFrame) -> DataFrame:
    """State, getter and action names of stores."""
    def section(start):
        body = F.regexp_extract(F.col("matched"), start + r"\{([^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+)\}", 1)
        flat = F.regexp_replace(F.regexp_replace(body, r"\{[^{}]*\}|\[[^\[\]]*\]", " "), r"\{[^{}]*\}|\([^()]*\)", " ")
        return _names(flat, r"(?:^|,)\s*(?:async\s+)?([A-Za-z_$][\w$]*)")
    return found.filter(F.col("type") == "pinia-stores").select(
        "project", "path", "line", "name", section(r"state\s*:\s*\(\s*\)\s*=>\s*\(\s*").alias("state"),
        section(r"getters\s*:\s*").alias("getters"), section(r"actions\s*:\s*").alias("actions"))


def compound_components(found: DataFrame) -> DataFrame:
    """Children assigned to a parent component, per file."""
    parts = F.split("name", r"\.")
    rows = found.filter(F.col("type") == "compound-components").select("project", "path", "line", parts[0].alias("parent"), parts[1].alias("child"))
    packed = F.sort_array(F.collect_list(F.struct("line", "child")))
    return rows.groupBy("project", "path", "parent").agg(F.transform(packed, lambda x: x["child"]).alias("children"))


def type_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("project", "type").agg(F.count(F.lit(1)).alias("occurrences"))


def pattern_summary(found: DataFrame, top: int = 5) -> DataFrame:
    """Total and the most common types per project."""
    counts = type_counts(found)
    total = counts.groupBy("project").agg(F.sum("occurrences").alias("total_patterns"), F.count(F.lit(1)).alias("types"))
    first = top_k(counts, ["project"], [F.desc("occurrences"), F.col("type")], top)
    common = first.groupBy("project").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "type"))), lambda x: x["type"]).alias("most_common"))
    return total.join(common, "project")


def recurring_hooks(found: DataFrame, least_total: int = 5, least_files: int = 3) -> DataFrame:
    """Custom hooks used in several files, in projects with more than a few uses."""
    hooks = found.filter(F.col("type") == "custom-hooks")
    per_file = hooks.groupBy("project", "name", "path").agg(F.count(F.lit(1)).alias("n"))
    per_name = per_file.groupBy("project", "name").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("uses"))
    enough = per_name.groupBy("project").agg(F.sum("uses").alias("total")).filter(F.col("total") > least_total)
    return per_name.filter(F.col("files") >= least_files).join(enough, "project", "left_semi").drop("uses")


def antipatterns(found: DataFrame, providers: int = 10, actions: int = 20) -> DataFrame:
    """Projects with too many providers and stores with too many actions."""
    many = found.filter(F.col("type") == "providers").groupBy("project").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > providers)
    many = many.select("project", F.lit("excessive-providers").alias("antipattern"), F.lit("multiple").alias("path"), F.col("n").cast("bigint").alias("n"))
    big = stores(found).withColumn("n", F.size("actions").cast("bigint")).filter(F.col("n") > actions)
    return many.unionByName(big.select("project", F.lit("bloated-store").alias("antipattern"), "path", "n"))


def best_practices(found: DataFrame, projects: DataFrame) -> DataFrame:
    """Which expected practices a project's framework shows."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    counts = found.groupBy("project").agg(n("hooks").alias("hooks"), n("custom-hooks").alias("custom"), n("composables").alias("composables"), n("pinia-stores").alias("stores"))
    joined = projects.select("project", "framework").distinct().join(counts, "project", "left").na.fill(0)
    react, vue = F.col("framework").isin("react", "react-native"), F.col("framework").isin("vue3", "nuxt3")
    status = lambda c: F.when(F.col(c) > 0, "follows").otherwise("unknown")
    row = lambda name, s: F.struct(F.lit(name).alias("practice"), s.alias("status"))
    rows = F.array_compact(F.array(
        F.when(react, row("Functional Components with Hooks", status("hooks"))),
        F.when(react & (F.col("custom") > 10), row("Custom Hooks for Logic Reuse", F.lit("follows"))),
        F.when(vue, row("Composition API with Composables", status("composables"))),
        F.when(vue & (F.col("stores") > 0), row("Pinia for State Management", F.lit("follows")))))
    return joined.select("project", F.explode(rows).alias("r")).select("project", "r.*")
