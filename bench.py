"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslode.queries import load  # noqa: E402
from corpuslode.session import build_session  # noqa: E402

HEADLINE = [
    "document_secret_scores", "unique_findings", "security_scores", "file_facts", "pattern_summary", "import_graph_edges", "graph_coupling",
    "graph_components", "coverage_gaps", "lcov_coverage", "convention_violations", "relevance_ranking", "context_packs", "vulnerable_dependencies",
    "project_frameworks", "event_counts_session",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the executors
    timings, errors = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # one failing query must not hide the others
            errors[name] = str(error).splitlines()[0][:200]
    files = spark.read.parquet(f"{folder}/documents.parquet").count()
    out = {
        "metric": "headline queries, total wall clock", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": int(cores), "files": files,
    }
    if "unique_findings" in timings:
        out["rule_scan_files_per_sec"] = round(files / timings["unique_findings"], 1)
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
