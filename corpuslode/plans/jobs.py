"""The seven analyses as jobs over a corpus: ``files(project, path, content, framework)``.

A job returns named tables.  What several tables need is written once to the
checkpoint folder, so the corpus is read once per job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.paths import CONTEXT_EXCLUDE, CONTEXT_INCLUDE, COVERAGE_EXCLUDE, COVERAGE_INCLUDE, GRAPH_EXCLUDE, GRAPH_INCLUDE, glob_filter
from ..operators import advisories as ad, architecture as ar, context as cx, conventions as cn, coverage as cv
from ..operators import facts, findings as fd, graph as gr, patterns as pt
from ..operators.scan import findings
from ..rules import PRACTICES, Rule, security_rules
from ..session import cut


def security_job(files: DataFrame, severities: Sequence[str] = (), categories: Sequence[str] = (), extra_rules: Sequence[Rule] = ()) -> dict[str, DataFrame]:
    """Findings, practices, summaries, score and advice; the score ignores the filters."""
    found, good = map(cut, fd.split_hits(cut(findings(files, [*security_rules(), *extra_rules, *PRACTICES]))))
    shown = fd.keep_listed(fd.keep_listed(found, "severity", severities), "category", categories)
    return {
        "findings": shown, "practices": good, "summary": fd.summaries(shown), "score": fd.security_score(found, good, files),
        "recommendations": fd.recommendations(shown),
    }


def dependency_graph_job(files: DataFrame) -> dict[str, DataFrame]:
    chosen = glob_filter(files, GRAPH_INCLUDE, GRAPH_EXCLUDE)
    edges = cut(gr.import_edges(chosen))
    nodes = chosen.selectExpr("project", "path AS id")
    measured = cut(gr.degrees(nodes, edges))
    circular = cut(gr.cycles(edges))
    return {
        "nodes": gr.flag_hotspots(measured), "edges": gr.circular_edges(edges, cut(gr.strong_components(edges))), "cycles": circular, "metrics": gr.coupling_metrics(measured),
        "hotspots": gr.hotspots(measured), "depth": gr.average_depth(nodes, edges),
    }


def coverage_job(files: DataFrame, coverage: DataFrame) -> dict[str, DataFrame]:
    chosen = glob_filter(files, COVERAGE_INCLUDE, COVERAGE_EXCLUDE)
    measured = cut(facts.file_facts(chosen))
    imports = measured.selectExpr("project", "path", "explode_outer(import_sources) AS source").filter("source IS NOT NULL")
    gaps = cut(cv.coverage_gaps(measured, coverage, cv.importer_counts(measured, imports)))
    return {
        "gaps": cv.suggest_tests(gaps), "critical": cv.critical_gaps(gaps), "summary": cv.gap_summary(chosen, gaps), "overall": cv.overall_coverage(coverage),
        "test_profile": cv.test_profile(files),
    }


def conventions_job(files: DataFrame) -> dict[str, DataFrame]:
    wanted = cut(cn.effective_conventions(files))
    found = cut(cn.violations(files, wanted))
    return {
        "conventions": wanted, "violations": found, "scores": cn.consistency_scores(found, files), "counts": cn.violation_counts(found), "fixes": cn.fix_groups(found),
    }


def context_job(files: DataFrame, tasks: DataFrame, focus: Sequence[str] = ()) -> dict[str, DataFrame]:
    chosen = glob_filter(files, CONTEXT_INCLUDE, CONTEXT_EXCLUDE)
    packed = cut(cx.context_pack(chosen, tasks, facts.import_rows(chosen), focus))
    return {"files": packed, "budget": cx.budget_use(packed, tasks), "patterns": cx.pack_patterns(packed, chosen)}


def patterns_job(files: DataFrame, kinds: Sequence[str] | None = None) -> dict[str, DataFrame]:
    found = cut(pt.occurrences(files, kinds))
    return {
        "occurrences": found, "summary": pt.pattern_summary(found), "recurring": pt.recurring_hooks(found), "antipatterns": pt.antipatterns(found),
        "practices": pt.best_practices(found, files), "routes": pt.routes(found), "queries": pt.queries(found), "messaging": pt.messaging(found), "stores": pt.stores(found),
    }


def architecture_job(files: DataFrame) -> dict[str, DataFrame]:
    measured = cut(facts.file_facts(files))
    imports = measured.selectExpr("project", "path", "explode_outer(import_sources) AS source").filter("source IS NOT NULL")
    return {
        "metrics": fd.corpus_metrics(measured), "layers": ar.assign_layer(measured), "components": ar.component_counts(measured), "complex": ar.complex_files(measured),
        "core": ar.core_modules(measured), "libraries": ar.libraries_used(imports), "state": ar.state_management(imports, measured), "insights": ar.insights(measured),
        "conventions": ar.framework_conventions(measured),
    }


def advisory_job(dependencies: DataFrame, locked: DataFrame, advisories: DataFrame) -> dict[str, DataFrame]:
    known = cut(ad.with_locked_versions(dependencies, locked))
    hit = cut(ad.vulnerable_dependencies(known, ad.advisory_ranges(advisories)))
    return {
        "vulnerable": hit, "findings": ad.dependency_findings(hit), "counts": ad.dependency_counts(known, hit), "by_severity": ad.vulnerabilities_by_severity(hit),
    }
