"""Coverage report sources: LCOV records and Istanbul JSON, one row per covered file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ["lines", "functions", "branches", "statements"]


def _percent(covered: Column, total: Column) -> Column:
    return F.when(total > 0, covered / total * 100).otherwise(0.0)


def _columns(counts: dict[str, tuple[Column, Column]]) -> list[Column]:
    out = []
    for kind in KINDS:
        total, covered = counts[kind]
        out += [
            total.cast("bigint").alias(f"{kind}_total"),
            covered.cast("bigint").alias(f"{kind}_covered"),
            _percent(covered, total).alias(f"{kind}_pct"),
        ]
    return out


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def parse_lcov(records: DataFrame, record: str = "record", root: str = "") -> DataFrame:
    """One coverage row per LCOV record; a record needs an ``SF:`` line.

    Everything is a row-level expression, so reports of any number of files parse
    without a shuffle.
    """
    text = F.col(record)

    def fields(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    hits = F.transform(fields(r"(?m)^DA:\d+,(\d+)"), lambda x: x.cast("bigint"))
    numbers = F.transform(fields(r"(?m)^DA:(\d+),\d+"), lambda x: x.cast("bigint"))
    missed = F.transform(F.filter(F.arrays_zip(numbers.alias("n"), hits.alias("h")), lambda x: x["h"] == 0), lambda x: x["n"])
    calls = F.transform(fields(r"(?m)^FNDA:(\d+)"), lambda x: x.cast("bigint"))
    names = fields(r"(?m)^FNDA:\d+,([^\r\n]+)")
    silent = F.transform(F.filter(F.arrays_zip(names.alias("n"), calls.alias("h")), lambda x: x["h"] == 0), lambda x: x["n"])
    last = lambda pattern: F.coalesce(F.try_element_at(fields(pattern), F.lit(-1)).cast("bigint"), F.lit(0))
    positive = lambda xs: F.size(F.filter(xs, lambda x: x > 0))
    lines = (F.size(hits), positive(hits))
    counts = {
        "lines": lines,
        "functions": (F.size(fields(r"(?m)^FN:(\d+)")), positive(calls)),
        "branches": (last(r"(?m)^BRF:(\d+)"), last(r"(?m)^BRH:(\d+)")),
        "statements": lines,
    }
    source = F.trim(F.regexp_extract(text, r"(?m)^SF:([^\r\n]*)", 1))
    keep = [c for c in records.columns if c != record]
    return (
        records.withColumn("path", relative_to(source, root) if root else source)
        .filter(F.col("path") != "")
        .select(*keep, "path", *_columns(counts), missed.alias("uncovered_lines"), silent.alias("uncovered_functions"))
    )


def lcov_records(reports: DataFrame, content: str = "content") -> DataFrame:
    """Split whole reports into records."""
    keep = [c for c in reports.columns if c != content]
    return reports.select(*keep, F.explode(F.split(F.col(content), "end_of_record")).alias("record")).filter(F.trim("record") != "")


def read_lcov(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """LCOV files; the record mark is the line separator, so one big report is split too."""
    lines = spark.read.option("lineSep", "end_of_record").text(path)
    return parse_lcov(lines.select(F.col("value").alias("record")), root=root)


COUNTERS = "map<string,bigint>"
SPOT = "struct<start:struct<line:bigint>>"
ISTANBUL = (
    f"map<string,struct<l:{COUNTERS},s:{COUNTERS},f:{COUNTERS},b:map<string,array<bigint>>,"
    f"statementMap:map<string,{SPOT}>,fnMap:map<string,struct<name:string>>>>"
)


def parse_istanbul(reports: DataFrame, content: str = "content", root: str = "") -> DataFrame:
    """One coverage row per file of an Istanbul report.

    Lines come from ``l`` when present, else from the statements that start on
    them; every branch arm is its own counter.
    """
    keep = [c for c in reports.columns if c != content]
    found = reports.select(*keep, F.explode(F.from_json(content, ISTANBUL)).alias("file", "c"))
    counters = "array<struct<key:string,value:bigint>>"
    entries = lambda m: F.coalesce(F.map_entries(m), F.array().cast(counters))
    located = F.transform(entries(F.col("c.s")), lambda e: F.struct(
        F.col("c.statementMap")[e["key"]]["start"]["line"].alias("line"), e["value"].alias("value")))
    arms = F.flatten(F.coalesce(F.map_values(F.col("c.b")), F.array().cast("array<array<bigint>>")))
    found = found.select(
        *keep, "file",
        F.map_entries(F.col("c.l")).alias("given"), entries(F.col("c.s")).alias("s"), entries(F.col("c.f")).alias("f"),
        arms.alias("arms"), F.array_sort(F.filter(located, lambda e: e["line"].isNotNull())).alias("located"),
        F.col("c.fnMap").alias("names"),
    )
    # Sorted by line and hits, the last statement of a line carries its most hits.
    last = F.filter("located", lambda e, i: F.coalesce(F.get("located", i + 1)["line"] != e["line"], F.lit(True)))
    derived = F.transform(last, lambda e: F.struct(e["line"].cast("string").alias("key"), e["value"].alias("value")))
    found = found.withColumn("lines", F.coalesce("given", derived))
    hit = lambda xs: F.size(F.filter(xs, lambda e: e["value"] > 0))
    counts = {
        "lines": (F.size("lines"), hit("lines")),
        "functions": (F.size("f"), hit("f")),
        "branches": (F.size("arms"), F.size(F.filter("arms", lambda x: x > 0))),
        "statements": (F.size("s"), hit("s")),
    }
    zero = lambda xs: F.transform(F.filter(xs, lambda e: e["value"] == 0), lambda e: e["key"])
    return found.select(
        *keep,
        (relative_to(F.col("file"), root) if root else F.col("file")).alias("path"),
        *_columns(counts),
        F.transform(zero("lines"), lambda x: x.cast("bigint")).alias("uncovered_lines"),
        F.transform(zero("f"), lambda k: F.coalesce(F.col("names")[k]["name"], k)).alias("uncovered_functions"),
    )


def report_format(name: Column, content: Column) -> Column:
    """``json``, ``lcov``, or null for a format that is not supported."""
    return (
        F.when(name.endswith(".json") | F.ltrim(content).startswith("{"), F.lit("json"))
        .when(name.contains("lcov") | content.contains("TN:"), F.lit("lcov"))
    )


def parse_reports(reports: DataFrame, name: str = "name", content: str = "content", root: str = "") -> DataFrame:
    """Reports of mixed formats, each read by what its name or text says it is."""
    kind = report_format(F.col(name), F.col(content))
    json_part = parse_istanbul(reports.filter(kind == "json"), content, root)
    lcov_part = parse_lcov(lcov_records(reports.filter(kind == "lcov"), content), root=root)
    return json_part.unionByName(lcov_part)


def read_coverage(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    reports = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("content"))
    return parse_reports(reports, root=root)
