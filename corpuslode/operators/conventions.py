"""Naming and style conventions: inferred by vote, checked per file, scored per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, text
from .ranking import first_examples, top_k

# Which paths hold components, and the hook name pattern.
COMPONENT_PATH = r"/(components?|screens?|pages?|views?)/.*\.(tsx|jsx|vue)$"
SCREEN_PATH = r"/(screens?|app/screens?)/.*\.(tsx|jsx)$"
NAVIGATOR_PATH = r"/(navigation|navigators?)/.*\.(tsx|jsx)$"
HOOK_NAME = "use[A-Z][a-zA-Z]+"
PLATFORM_SUFFIX = r"\.(ios|android|native|web)\.(tsx?|jsx?)$"
PLATFORM_EXTENSIONS = [
    ".ios.tsx", ".android.tsx", ".native.tsx", ".web.tsx", ".ios.ts", ".android.ts", ".native.ts", ".web.ts",
]
REACT, MOBILE, VUE = ("react", "react-native", "expo"), ("react-native", "expo"), ("vue3", "nuxt3")
MAJORITY = 0.7
CATEGORIES = ["naming", "structure", "imports", "exports", "style", "framework-specific"]
IMPACT = {"error": 10, "warning": 5, "info": 2}


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), path)


def component_casing(files: DataFrame) -> DataFrame:
    """Casing of component files by vote; no majority means Pascal case at 0.5."""
    named = files.filter(_rooted(F.col("path")).rlike(COMPONENT_PATH)).select(
        "project", "path", text.casing_of(paths.stem(F.col("path"))).alias("casing"))
    share = lambda c: F.count_if(F.col("casing") == c) / F.count(F.lit(1))
    votes = named.groupBy("project").agg(
        share("PascalCase").alias("p"), share("kebab-case").alias("k"), share("camelCase").alias("c"), F.count(F.lit(1)).alias("occurrences"))
    won = F.array_compact(F.array(*[
        F.when(F.col(v) > MAJORITY, F.struct(F.lit(n).alias("pattern"), F.col(v).alias("confidence")))
        for v, n in (("p", "PascalCase"), ("k", "kebab-case"), ("c", "camelCase"))
    ], F.struct(F.lit("PascalCase").alias("pattern"), F.lit(0.5).alias("confidence"))))
    best = votes.select("project", F.element_at(won, 1).alias("w"), "occurrences")
    return best.select("project", F.lit("naming").alias("category"), F.lit("Component naming").alias("rule"), "w.pattern", "w.confidence",
                       "occurrences").join(first_examples(named, ["project"], "path", ["path"]), "project")


def hook_naming(files: DataFrame) -> DataFrame:
    """Projects that keep ``use*`` files in hook or composable folders."""
    base = paths.basename(F.col("path"))
    found = files.filter(base.startswith("use") & paths.any_contains(_rooted(F.col("path")), ["/hooks/", "/composables/"])).select(
        "project", "path", "framework", base.alias("base"))
    rule = F.when(F.max("framework").isin(*REACT), "Hook naming").otherwise("Composable naming")
    counted = found.groupBy("project").agg(rule.alias("rule"), F.count(F.lit(1)).alias("occurrences"))
    return counted.select("project", F.lit("naming").alias("category"), "rule", F.lit(HOOK_NAME).alias("pattern"),
                          F.lit(0.95).alias("confidence"), "occurrences").join(
        first_examples(found, ["project"], "base", ["path"]), "project")


def _vote(counted: DataFrame, category: str, rule: str, first: str, second: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    total = a + b
    pattern = F.when(a / total > MAJORITY, first).when(b / total > MAJORITY, second).otherwise("mixed")
    confidence = F.when(a / total > MAJORITY, a / total).when(b / total > MAJORITY, b / total).otherwise(0.5)
    seen = F.when(a / total > MAJORITY, a).when(b / total > MAJORITY, b).otherwise(total)
    return counted.filter(total > 0).select(
        "project", F.lit(category).alias("category"), F.lit(rule).alias("rule"), pattern.alias("pattern"),
        confidence.alias("confidence"), seen.cast("bigint").alias("occurrences"))


def _sample(files: DataFrame, n: int | None) -> DataFrame:
    return top_k(files, ["project"], [F.col("path")], n).drop("rank") if n else files


IMPORT_SOURCES = r"""regexp_extract_all(content, 'import\\s+.*\\s+from\\s+[\'"](.+)[\'"]', 1)"""


def _import_votes(relative: str, absolute: str) -> list[Column]:
    return [
        F.sum(F.expr("size(filter(s, x -> startswith(x, '.')))")).alias(relative),
        F.sum(F.expr("size(filter(s, x -> NOT startswith(x, '.') AND NOT rlike(x, '^[a-z@]')))")).alias(absolute),
    ]


def _quote_votes(column: str, single: str, double: str) -> list[Column]:
    return [
        F.sum(F.regexp_count(column, F.lit(r"'[^'\n]*'"))).alias(single),
        F.sum(F.regexp_count(column, F.lit(r'"[^"\n]*"'))).alias(double),
    ]


def import_style(files: DataFrame, sample_files: int | None = None, per_file: int | None = None) -> DataFrame:
    """Relative or absolute imports by vote; package names do not vote."""
    found = F.expr(IMPORT_SOURCES)
    found = F.slice(found, 1, per_file) if per_file else found
    per = _sample(files, sample_files).select("project", found.alias("s"))
    counted = per.groupBy("project").agg(*_import_votes("a", "b"))
    return _vote(counted, "imports", "Import style", "relative", "absolute")


def quote_style(files: DataFrame, sample_files: int | None = None, lines: int | None = None) -> DataFrame:
    """Single or double quotes by vote over the literals of every line."""
    body = F.col("content")
    body = F.substring_index(body, "\n", lines) if lines else body
    counted = _sample(files, sample_files).select("project", body.alias("t")).groupBy("project").agg(*_quote_votes("t", "a", "b"))
    return _vote(counted, "style", "Quote style", "single", "double")


def effective_conventions(files: DataFrame) -> DataFrame:
    """One row per project: what was detected, else the defaults.

    Both text votes are counted in the same pass over the files.
    """
    imports = F.expr(IMPORT_SOURCES)
    counted = files.select("project", "framework", "content", imports.alias("s")).groupBy("project").agg(
        F.max("framework").alias("framework"), *_import_votes("ra", "ab"), *_quote_votes("content", "sq", "dq"))

    def winner(a, b, first, second, none):
        total = F.col(a) + F.col(b)
        return F.when(total == 0, none).when(F.col(a) / total > MAJORITY, first).when(F.col(b) / total > MAJORITY, second).otherwise("mixed")

    casing = component_casing(files).select("project", F.col("pattern").alias("c"))
    return counted.join(casing, "project", "left").select(
        "project", "framework", F.coalesce("c", F.lit("PascalCase")).alias("component_casing"),
        winner("ra", "ab", "relative", "absolute", "mixed").alias("import_style"), winner("sq", "dq", "single", "double", "single").alias("quotes"))


ROW = ("array<struct<line:int,category:string,severity:string,rule:string,expected:string,actual:string,"
       "auto_fixable:boolean,fix_type:string,new_value:string>>")


def _row(rule, category, severity, line="0", expected="''", actual="''", fix=None, new="''") -> str:
    fixable = "true" if fix else "false"
    return (f"named_struct('line', int({line}), 'category', '{category}', 'severity', '{severity}', 'rule', '{rule}', "
            f"'expected', {expected}, 'actual', {actual}, 'auto_fixable', {fixable}, 'fix_type', '{fix or ''}', 'new_value', {new})")


def violations(files: DataFrame, conventions: DataFrame, grouping: bool = True, quote_lines: int | None = None) -> DataFrame:
    """Every violation of every file, from one pass over the text."""
    path, stem = F.col("path"), F.col("stem")
    df = files.select("project", "path", "content", paths.stem(path).alias("stem"), _rooted(path).alias("full")).join(conventions, "project")
    df = (
        df.withColumn("pascal", text.to_pascal(stem)).withColumn("camel", text.to_camel(stem)).withColumn("kebab", text.to_kebab(stem))
        .withColumn("lines", F.split("content", "\n", -1)).drop("content")
        .withColumn("at", F.expr(r"filter(transform(lines, (l, i) -> CASE WHEN rlike(l, '^import\\s+') THEN i + 1 END), x -> x IS NOT NULL)"))
        .withColumn("block", F.expr("CASE WHEN size(at) > 0 THEN slice(lines, at[0], element_at(at, -1) - at[0] + 1) ELSE array() END"))
        .withColumn("suffix", F.regexp_extract("full", PLATFORM_SUFFIX, 0))
    )
    shapes = {name: pattern for name, pattern in text.CASINGS}
    converted = {"PascalCase": ("pascal", "MyComponent"), "camelCase": ("camel", "myUtility"), "kebab-case": ("kebab", "my-component")}
    naming = " ".join(
        f"WHEN component_casing = '{name}' AND NOT rlike(stem, '{shapes[name]}') THEN "
        + _row("Component naming", "naming", "warning", expected=f"'{name} (e.g., {example})'", actual="stem", fix="rename", new=column)
        for name, (column, example) in converted.items()
    )
    bad_hook = f"NOT rlike(stem, '{HOOK_NAME}')"
    react, mobile, vue = ("('" + "', '".join(g) + "')" for g in (REACT, MOBILE, VUE))
    hook = lambda rule: _row(rule, "naming", "warning", expected=f"'{HOOK_NAME}'", actual="stem")
    suffixed = lambda rule, end: _row(rule, "framework-specific", "warning", expected=f"concat(stem, '{end}')", actual="stem",
                                      fix="rename", new=f"concat(stem, '{end}')")
    allowed = "('" + "', '".join(PLATFORM_EXTENSIONS) + "')"
    cases = [
        f"CASE WHEN rlike(full, r'{COMPONENT_PATH}') THEN CASE {naming} END END",
        f"CASE WHEN framework IN {react} AND (contains(full, '/hooks/') OR contains(full, '/composables/')) AND {bad_hook} THEN {hook('Hook naming')} END",
        f"CASE WHEN framework IN {vue} AND contains(full, '/composables/') AND {bad_hook} THEN {hook('Composable naming')} END",
        f"CASE WHEN framework IN {mobile} AND rlike(full, r'{SCREEN_PATH}') AND NOT endswith(stem, 'Screen') THEN {suffixed('Screen naming', 'Screen')} END",
        f"CASE WHEN framework IN {mobile} AND rlike(full, r'{NAVIGATOR_PATH}') AND NOT endswith(stem, 'Navigator') AND NOT contains(stem, 'Navigation') "
        f"THEN {suffixed('Navigator naming', 'Navigator')} END",
        f"CASE WHEN framework IN {mobile} AND suffix <> '' AND suffix NOT IN {allowed} THEN "
        + _row("Platform-specific file extension", "framework-specific", "info", expected=f"'{', '.join(PLATFORM_EXTENSIONS)}'", actual="suffix") + " END",
    ]
    if grouping:
        cases.append(
            r"CASE WHEN size(block) > 3 AND NOT exists(sequence(0, size(block) - 2), i -> trim(block[i]) = '' AND rlike(block[i + 1], '^import\\s+')) THEN "
            + _row("Import grouping", "imports", "info", line="at[0]", fix="reorder") + " END")
    quote_scope = f"slice(lines, 1, {quote_lines})" if quote_lines else "lines"
    first_line = lambda test: f"array_position(transform({quote_scope}, l -> {test}), true)"
    quotes = "\n".join([
        "CASE quotes WHEN 'single' THEN " + first_line("""contains(l, '"') AND NOT contains(l, '<') AND NOT contains(l, '="')"""),
        "WHEN 'double' THEN " + first_line(r"""contains(l, '\'') AND NOT rlike(l, '//|/\\*')"""), "ELSE 0 END",
    ])
    df = df.withColumn("quote_line", F.expr(quotes))
    expected = r"""CASE quotes WHEN 'single' THEN 'single quotes (\')' ELSE 'double quotes (")' END"""
    actual = r"""CASE quotes WHEN 'single' THEN 'double quotes (")' ELSE 'single quotes (\')' END"""
    cases.append("CASE WHEN quote_line > 0 THEN " + _row("Quote style", "style", "info", "quote_line", expected, actual, fix="replace") + " END")
    source = r"""regexp_extract(l, 'from\\s+[\'"](.+)[\'"]', 1)"""
    offends = (r"s.s <> '' AND ((import_style = 'relative' AND NOT startswith(s.s, '.') AND NOT rlike(s.s, '^[a-z@]')) "
               "OR (import_style = 'absolute' AND startswith(s.s, '.')))")
    style = _row("Import style", "imports", "info", "s.n", "concat(import_style, ' import')", "s.s")
    imports = (f"CASE WHEN import_style IN ('relative', 'absolute') THEN transform(filter(transform(block, (l, i) -> "
               f"named_struct('s', {source}, 'n', at[0] + i)), s -> {offends}), s -> {style}) END")
    single = f"filter(array({', '.join(cases)}), x -> x IS NOT NULL)"
    found = F.expr(f"concat(cast({single} AS {ROW}), coalesce(cast({imports} AS {ROW}), array()))")
    return df.select("project", "path", "framework", F.explode_outer(found).alias("v")).filter("v IS NOT NULL").select(
        "project", "path", "framework", "v.*")


def consistency_scores(found: DataFrame, projects: DataFrame) -> DataFrame:
    """Score per project and category, and the rounded mean over all six categories."""
    impact = F.lit(0)
    for severity, points in IMPACT.items():
        impact = F.when(F.col("severity") == severity, points).otherwise(impact)
    lost = found.groupBy("project", "category").agg(F.sum(impact).alias("lost"))
    wide = projects.select("project").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])))
    scored = wide.join(lost, ["project", "category"], "left").select(
        "project", "category", F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).alias("score"))
    pack = lambda test: F.array_sort(F.array_compact(F.collect_list(F.when(test, F.col("category")))))
    s = F.col("score")
    return scored.groupBy("project").agg(
        F.round(F.sum(s) / len(CATEGORIES)).cast("int").alias("overall"),
        *[F.max(F.when(F.col("category") == c, s)).alias(c.replace("-", "_")) for c in CATEGORIES],
        pack(s >= 90).alias("strengths"), pack(s < 70).alias("weaknesses"))


def violation_counts(found: DataFrame) -> DataFrame:
    count = lambda column, v: F.count_if(F.col(column) == v)
    return found.groupBy("project").agg(
        *[count("category", c).alias(c.replace("-", "_")) for c in CATEGORIES],
        *[count("severity", s).alias(s) for s in IMPACT], F.count_if("auto_fixable").alias("auto_fixable"))


def fix_groups(found: DataFrame) -> DataFrame:
    """Auto-fixes grouped by category and rule; the files stay in the violation rows."""
    fixes = found.filter("auto_fixable")
    n = F.count(F.lit(1))
    return fixes.groupBy("project", "category", "rule").agg(
        n.alias("fixes"), F.min_by("severity", F.struct("path", "line")).alias("severity"),
        F.when(n > 10, "high").when(n > 5, "medium").otherwise("low").alias("impact"), F.lit(True).alias("safe"),
    )
