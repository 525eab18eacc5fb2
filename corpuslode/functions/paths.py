"""Column functions over file paths, and glob predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extname(path: Column) -> Column:
    """Last dotted suffix of the file name, with its dot; empty for dotfiles."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extname(path)))


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def _glob_part(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif text.startswith("**", i):
            out, i = out + r".*", i + 2
        elif text[i] == "*":
            out, i = out + r"[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif text[i] == "{":
            end = text.index("}", i)
            options = "|".join(_glob_part(part) for part in text[i + 1 : end].split(","))
            out, i = f"{out}(?:{options})", end + 1
        else:
            out, i = out + re.escape(text[i]), i + 1
    return out


def glob_regex(globs: Iterable[str]) -> str:
    """One anchored pattern for a list of globs (``**``, ``*``, ``?``, ``{a,b}``)."""
    return "^(?:" + "|".join(_glob_part(g) for g in globs) + ")$"


def glob_match(path: Column, include: Iterable[str], exclude: Iterable[str] = ()) -> Column:
    include, exclude = list(include), list(exclude)
    keep = path.rlike(glob_regex(include)) if include else F.lit(True)
    return keep & ~path.rlike(glob_regex(exclude)) if exclude else keep


def glob_filter(df: DataFrame, include: Iterable[str], exclude: Iterable[str] = (), path: str = "path") -> DataFrame:
    """Rows whose path matches any include glob and no exclude glob."""
    return df.filter(glob_match(F.col(path), include, exclude))


def any_contains(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


# Default globs of the dependency, coverage and relevance jobs.
GRAPH_INCLUDE = ["src/**/*.{ts,tsx,js,jsx,vue}", "components/**/*.{ts,tsx,js,jsx,vue}"]
GRAPH_EXCLUDE = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/*.test.*", "**/*.spec.*"]
COVERAGE_INCLUDE = ["src/**/*.{ts,tsx,js,jsx,vue}"]
COVERAGE_EXCLUDE = ["**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/node_modules/**"]
CONTEXT_INCLUDE = ["src/**/*.{ts,tsx,js,jsx,vue}", "lib/**/*.{ts,tsx,js,jsx}"]
CONTEXT_EXCLUDE = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/coverage/**"]
TEST_GLOBS = ["**/*.test.{ts,tsx,js,jsx}", "**/*.spec.{ts,tsx,js,jsx}", "**/__tests__/**/*.{ts,tsx,js,jsx}"]

# Directory words that decide a file's class, in test order.
CLASS_DIRS = [
    ("component", ["/components/"]),
    ("hook", ["/hooks/"]),
    ("composable", ["/composables/"]),
    ("store", ["/stores/", "/store/"]),
    ("service", ["/services/", "/api/"]),
]


def classify_file(path: Column) -> Column:
    """Module class from the path; the first matching rule wins."""
    low, name = F.lower(path), stem(path)
    out = F.when(any_contains(low, CLASS_DIRS[0][1]), F.lit(CLASS_DIRS[0][0]))
    for label, dirs in CLASS_DIRS[1:]:
        out = out.when(any_contains(low, dirs), F.lit(label))
    out = out.when(low.contains("/providers/") | F.lower(name).contains("provider"), F.lit("provider"))
    hookish = name.startswith("use") & (F.length(name) > 3)
    out = out.when(hookish & low.contains("vue"), F.lit("composable")).when(hookish, F.lit("hook"))
    return out.otherwise(F.lit("utility"))


# Purpose of a module by the first directory word found.
PURPOSES = [
    ("routes/", "API endpoint handler"),
    ("services/", "Business logic service"),
    ("models/", "Data model"),
    ("plugins/", "Fastify plugin"),
    ("hooks/", "Request lifecycle hook"),
    ("schemas/", "JSON Schema validation"),
    ("consumers/", "Kafka consumer"),
    ("producers/", "Kafka producer"),
    ("streams/", "Stream processing pipeline"),
    ("db/", "Database connection/query"),
    ("database/", "Database connection/query"),
    ("config/", "Application configuration"),
    ("utils/", "Utility functions"),
    ("middleware/", "Middleware"),
]


def infer_purpose(path: Column) -> Column:
    low = F.lower(path)
    out = F.when(low.contains(PURPOSES[0][0]), F.lit(PURPOSES[0][1]))
    for word, purpose in PURPOSES[1:]:
        out = out.when(low.contains(word), F.lit(purpose))
    return out.otherwise(F.lit("Core module"))


# Words that make a path security related.
SECURITY_WORDS = ["auth", "login", "security", "crypto", "session", "permission", "cors", "token", "password", "credential"]


def is_security_path(path: Column) -> Column:
    return any_contains(F.lower(path), SECURITY_WORDS)


# Directories that make a file core or important.
CORE_DIRS = ["/utils/", "/lib/", "/core/", "/services/", "/api/", "/store", "/composables/"]
IMPORTANT_DIRS = ["/hooks/", "/providers/", "/context/"]
STANDARD_DIRS = ["/components/", "/pages/"]


def path_criticality(path: Column) -> Column:
    """Criticality class that the path alone decides."""
    low = F.lower(path)
    return (
        F.when(any_contains(low, CORE_DIRS), F.lit("core"))
        .when(any_contains(low, IMPORTANT_DIRS), F.lit("important"))
        .when(any_contains(low, STANDARD_DIRS), F.lit("standard"))
        .otherwise(F.lit("peripheral"))
    )


def is_test_file(path: Column) -> Column:
    return any_contains(path, [".test.", ".spec.", "__tests__"])


def normalize_path(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments; an escape above the root gives null."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("inside"))

    def step(acc, seg):
        up = seg == ".."
        kept = (
            F.when((seg == "") | (seg == "."), acc["kept"])
            .when(up, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0))))
            .otherwise(F.array_append(acc["kept"], seg))
        )
        return F.struct(kept.alias("kept"), (acc["inside"] & ~(up & (F.size(acc["kept"]) == 0))).alias("inside"))

    folded = F.aggregate(F.split(path, "/"), start, step)
    return F.when(folded["inside"], F.array_join(folded["kept"], "/"))
