import json

from pyspark.sql import functions as F

from corpuslode.sources import corpus, coverage_reports as reports, manifests as mf
from corpuslode.sources.sinks import write_findings

LCOV = "TN:\nSF:/repo/src/utils/a.ts\nFN:1,load\nFNDA:0,load\nDA:1,3\nDA:2,0\nBRF:4\nBRH:1\nend_of_record\nSF:/repo/src/b.ts\nend_of_record\n"
ISTANBUL = json.dumps({"/repo/src/c.ts": {
    "s": {"0": 1, "1": 0, "2": 0}, "statementMap": {"0": {"start": {"line": 1}}, "1": {"start": {"line": 1}}, "2": {"start": {"line": 2}}},
    "f": {"0": 0}, "fnMap": {"0": {"name": "go"}}, "b": {"0": [1, 0]}}})


def test_lcov_file_and_text(spark, tmp_path):
    (tmp_path / "lcov.info").write_text(LCOV)
    rows = {r.path: r for r in reports.read_lcov(spark, str(tmp_path), root="/repo").collect()}
    a = rows["src/utils/a.ts"]
    assert (a.lines_total, a.lines_covered, a.lines_pct, a.uncovered_lines) == (2, 1, 50.0, [2])
    assert (a.functions_total, a.functions_covered, a.uncovered_functions, a.branches_total, a.branches_covered) == (1, 0, ["load"], 4, 1)
    assert (rows["src/b.ts"].lines_total, rows["src/b.ts"].lines_pct) == (0, 0.0)


def test_report_formats_are_told_apart(spark):
    df = spark.createDataFrame([("p", "x.json", ISTANBUL), ("p", "cov/lcov.info", LCOV), ("p", "other.xml", "<x/>")], "project string, name string, content string")
    rows = {r.path: r for r in reports.parse_reports(df.drop("project").withColumn("project", F.lit("p")), root="/repo").collect()}
    assert set(rows) == {"src/c.ts", "src/utils/a.ts", "src/b.ts"}
    c = rows["src/c.ts"]
    assert (c.lines_total, c.lines_covered, c.uncovered_lines) == (2, 1, [2])
    assert (c.statements_total, c.statements_covered, c.branches_total, c.branches_covered, c.uncovered_functions) == (3, 1, 2, 1, ["go"])


def test_read_corpus_and_sink(spark, tmp_path):
    for name, body in {"p1/src/a.ts": "one\n", "p1/node_modules/x.ts": "no", "p2/src/b/c.tsx": "two é"}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    got = corpus.read_corpus(spark, str(tmp_path / "in"), ["src/**/*.{ts,tsx}"], ["**/node_modules/**"])
    assert {(r.project, r.path, r.content) for r in got.collect()} == {("p1", "src/a.ts", "one\n"), ("p2", "src/b/c.tsx", "two é")}
    corpus.write_corpus(got, str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 2
    found = got.select("project", "path", F.lit("high").alias("severity"))
    write_findings(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("severity = 'high'").count() == 2


def test_manifests_and_lockfiles(spark):
    manifest = {"dependencies": {"lodash": "^4.17.15", "x": "workspace:^1.2.0"}, "devDependencies": {"vitest": "~1.0.0"}, "peerDependencies": {"react": ">=18.0.0"},
                "optionalDependencies": {"o": "1.0.0"}, "engines": {"node": ">=18"}}
    df = spark.createDataFrame([("p", json.dumps(manifest)), ("bad", "{not json")], "project string, json string")
    rows = {r.name: (r.version, r.is_dev, r.is_optional, r.is_peer) for r in mf.read_manifests(df).collect()}
    assert rows == {"lodash": ("4.17.15", False, False, False), "x": ("1.2.0", False, False, False), "vitest": ("1.0.0", True, False, False), "react": ("18.0.0", False, False, True)}
    new = {"lockfileVersion": 3, "packages": {"": {"version": "0"}, "node_modules/lodash": {"version": "4.17.21"}}, "dependencies": {"lodash": {"version": "1.0.0"}}}
    old = {"lockfileVersion": 1, "dependencies": {"lodash": {"version": "3.0.0"}}}
    locks = spark.createDataFrame([("p", json.dumps(new)), ("q", json.dumps(old))], "project string, json string")
    assert {(r.project, r.name, r.locked) for r in mf.read_lockfiles(locks).collect()} == {("p", "lodash", "4.17.21"), ("q", "lodash", "3.0.0")}


def test_advisory_fields(spark, tmp_path):
    from corpuslode.operators import advisories as ad
    dump = [{"id": "GHSA-1", "aliases": ["CVE-1"], "references": [{"type": "WEB", "url": "https://a"}, {"type": "ADVISORY", "url": "https://github.com/advisories/1"}],
             "affected": [{"package": {"ecosystem": "npm", "name": "lodash"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "4.17.20"}]}]}],
             "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}]}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, dump)))
    advisories = mf.read_advisories(spark, str(tmp_path / "a.json"))
    row = ad.advisory_ranges(advisories).collect()[0]
    assert (row.severity, row.cves, row.fixed_in, row.url, row.introduced, row.fixed) == ("high", ["CVE-1"], "4.17.20", "https://github.com/advisories/1", "0", "4.17.20")
    assert ad.advisory_ranges(advisories, compat=True).collect()[0].severity == "low"
    deps = spark.createDataFrame([("p", "lodash", v, False) for v in ("4.17.19", "4.17.20", "4.17.20-rc1", "0.0.0")], "project string, name string, version string, is_dev boolean")
    hit = ad.vulnerable_dependencies(deps, ad.advisory_ranges(advisories))
    assert sorted(r.version for r in hit.collect()) == ["4.17.19", "4.17.20-rc1"]


def test_files_that_are_not_utf8_are_skipped(spark, tmp_path):
    folder = tmp_path / "in" / "p" / "src"
    folder.mkdir(parents=True)
    (folder / "good.ts").write_text("é")
    (folder / "bad.ts").write_bytes(b"caf\xe9")
    assert [r.path for r in corpus.read_corpus(spark, str(tmp_path / "in")).collect()] == ["src/good.ts"]


def test_advisories_by_ecosystem_range_type_and_listed_version(spark, tmp_path):

    def advisory(key, ecosystem, ranges, versions=None):
        return {"id": key, "affected": [{"package": {"ecosystem": ecosystem, "name": "redis"}, "ranges": ranges, "versions": versions or []}]}

    rows = [
        advisory("OTHER", "PyPI", [{"type": "SEMVER", "events": [{"introduced": "0"}]}]),
        advisory("LISTED", "npm", [], ["4.0.0"]),
        advisory("GIT", "npm", [{"type": "GIT", "events": [{"introduced": "1234567"}]}]),
        advisory("ORDER", "npm", [{"type": "SEMVER", "events": [{"introduced": "5.0.0"}, {"introduced": "1.0.0"}, {"fixed": "2.0.0"}]}]),
    ]
    (tmp_path / "dump.json").write_text("\n".join(map(json.dumps, rows)))
    from corpuslode.operators import advisories as ad

    ranges = ad.advisory_ranges(mf.read_advisories(spark, str(tmp_path / "dump.json")))
    deps = spark.createDataFrame([("p", "redis", v) for v in ("1.5.0", "3.0.0", "4.0.0", "6.0.0")], "project string, name string, version string")
    hits = {(r["version"], r["id"]) for r in ad.vulnerable_dependencies(deps, ranges).collect()}
    assert hits == {("4.0.0", "LISTED"), ("1.5.0", "ORDER"), ("6.0.0", "ORDER")}


def test_dependency_counts_build_their_items_once(spark, tmp_path, monkeypatch):
    from corpuslode.queries import advisories as qa

    spark.createDataFrame([(i, i % 7) for i in range(60)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = [(order, (order * 13 + line * 7) % 60, line * 3 + order, line) for order in range(20) for line in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    built, items = [], qa._items
    monkeypatch.setattr(qa, "_items", lambda *a: built.append(1) or items(*a))
    counts = qa.dependency_counts(spark, str(tmp_path))
    assert len(built) == 1 and "lineitem" not in counts._jdf.queryExecution().toString()
    named = {}
    for order, part, _, line in rows:
        name = (order, part % 50)
        named[name] = min(line, named.get(name, line))
    total = {order: [n for (o, _), n in named.items() if o == order and n <= 6] for order in range(20)}
    assert {(r.project, r.total, r.development) for r in counts.collect()} == {(o, len(n), sum(3 < x <= 5 for x in n)) for o, n in total.items()}
