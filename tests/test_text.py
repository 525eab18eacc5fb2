import pytest
from pyspark.sql import functions as F

from corpuslode.functions import paths, text, versions as vs
from corpuslode.operators import facts

CODE = """import a, { b as c, d } from './x';
import * as ns from "pkg";
import './side.css';
/* if (x) {
   while */
export const one = 1;
export function two() { return one ? 1 : 2; } // if (no)
export { c as three, d };
export default function () {
  if (a && b) { for (let i = 0; i < 3; i++) {} for (const k of d) {} }
  const s = "if (quoted) && //";
  switch (a) { case 1: break; }
  try {} catch (e) {}
}
"""


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(column.alias("v")).collect()[0]["v"]


def test_line_numbers_survive_stripping(spark):
    c = F.col("c")
    row = spark.createDataFrame([(CODE,)], "c string").select(
        text.line_count(c).alias("n"), text.line_count(text.code_text(c)).alias("m"), text.line_count(text.bare_text(c)).alias("k"),
        text.code_text(c).alias("code"), text.bare_text(c).alias("bare")).collect()[0]
    assert row.n == row.m == row.k == CODE.count("\n") + 1
    assert "while" not in row.code and "no" not in row.code.split("two")[1].split("\n")[0]
    assert '"if (quoted) && //"' in row.code and "quoted" not in row.bare


def test_complexity_counts_decisions(spark):
    # ternary, if, &&, counted for, catch, case; for-of does not count
    bare = text.bare_text(F.col("c"))
    df = spark.createDataFrame([(CODE,)], "c string").select(text.complexity(bare).alias("a"), text.complexity(bare, compat=True).alias("b"))
    assert tuple(df.collect()[0]) == (7, 6)


def test_imports_and_exports(spark, files):
    rows = facts.import_rows(files(("p", "a.ts", CODE, "node"))).orderBy("position").collect()
    assert [(r.source, r.specifiers) for r in rows] == [
        ("./x", ["a", "b as c", "d"]), ("pkg", ["* as ns"]), ("./side.css", [])]
    got = facts.file_facts(files(("p", "a.ts", CODE, "node"))).collect()[0]
    assert got.exports == ["one", "two", "three", "d", "default"]


def test_match_lines_count_every_match(spark):
    body = "x\nfoo foo\n\nfoo"
    got = spark.createDataFrame([(body,)], "c string").select(text.match_lines(F.col("c"), "foo").alias("v")).collect()[0].v
    assert got == [2, 2, 4]


@pytest.mark.parametrize("secret, masked", [("abc", "abc****"), ("123456789012", "1234****"), ("1234567890123", "1234****0123")])
def test_mask(spark, secret, masked):
    assert value(spark, text.mask_secret(F.lit(secret))) == masked


def test_truncation_keeps_head_and_tail(spark):
    body = "".join(chr(97 + i % 26) for i in range(1000))
    got = value(spark, text.truncate_middle(F.lit(body), F.lit(100)))
    assert got == body[:240] + text.TRUNCATION_MARKER + body[-80:]
    assert len(got) == value(spark, text.truncated_length(F.lit(1000), F.lit(100)))
    assert value(spark, text.truncate_middle(F.lit("short"), F.lit(100))) == "short"


@pytest.mark.parametrize("name, casing, pascal, camel, kebab", [
    ("my-card_box", "other", "MyCardBox", "myCardBox", "my-card_box"), ("MyCard", "PascalCase", "MyCard", "myCard", "my-card"),
    ("utils", "camelCase", "Utils", "utils", "utils"), ("my-card", "kebab-case", "MyCard", "myCard", "my-card")])
def test_casing(spark, name, casing, pascal, camel, kebab):
    n = F.lit(name)
    got = spark.range(1).select(text.casing_of(n), text.to_pascal(n), text.to_camel(n), text.to_kebab(n)).collect()[0]
    assert tuple(got) == (casing, pascal, camel, kebab)


@pytest.mark.parametrize("path, want", [
    ("src/components/a.tsx", "component"), ("src/hooks/x.ts", "hook"), ("src/composables/x.ts", "composable"), ("src/store/x.ts", "store"),
    ("src/api/x.ts", "service"), ("src/AuthProvider.tsx", "provider"), ("src/useThing.ts", "hook"), ("src/vue/useThing.ts", "composable"), ("src/x.ts", "utility")])
def test_classify(spark, path, want):
    assert value(spark, paths.classify_file(F.lit(path))) == want


@pytest.mark.parametrize("path, want", [("a/b/../c/./d", "a/c/d"), ("a/../../x", None), ("src/x", "src/x")])
def test_normalize(spark, path, want):
    assert value(spark, paths.normalize_path(F.lit(path))) == want


def test_globs():
    import re
    rx = re.compile(paths.glob_regex(["src/**/*.{ts,tsx}", "**/*.test.*"]))
    assert rx.match("src/a.ts") and rx.match("src/a/b/c.tsx") and rx.match("x/y.test.js") and rx.match("y.test.js")
    assert not rx.match("lib/a.ts") and not rx.match("src/a.vue")


@pytest.mark.parametrize("spec, want", [
    ("^4.17.15", "4.17.15"), ("workspace:^1.2.0", "1.2.0"), ("npm:z@2.3.4", "2.3.4"), ("git+ssh://h/r.git", "0.0.0"), ("latest", "0.0.0"),
    ("~1.0.0", "1.0.0"), (">=1.0.0 || 2.0.0", "1.0.0"), ("1.0.0 - 2.0.0", "1.0.0"), ("*", "0.0.0"), ("file:../x", "0.0.0")])
def test_versions(spark, spec, want):
    assert value(spark, vs.parse_version(F.lit(spec))) == want


def test_version_order(spark):
    order = ["0.9.9", "1.0.0-beta", "1.0.0", "1.2", "1.10.0", "2.0.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(vs.version_key(F.col("v"))).collect()
    assert [r.v for r in rows] == order
