from corpuslode.plans import jobs
from corpuslode.queries.templates import TEMPLATES


def test_jobs_run_on_one_corpus(spark):
    rows = []
    for i, (path, body) in enumerate(TEMPLATES):
        fill = lambda s: __import__("re").sub(r"@[A-Z]+\d*@", "1", s)
        rows.append(("p", fill(path), fill(body), ["react", "fastify", "expo", "nuxt3"][i % 4]))
    files = spark.createDataFrame(rows, "project string, path string, content string, framework string")
    security = jobs.security_job(files, severities=["critical"])
    assert {r.severity for r in security["findings"].collect()} == {"critical"}
    score = security["score"].collect()[0]
    assert 0 <= score.score <= 100
    graph = jobs.dependency_graph_job(files)
    assert graph["metrics"].collect()[0].total_modules == graph["nodes"].count()
    assert graph["edges"].filter("circular").count() >= 2  # store and composable import each other
    found = jobs.conventions_job(files)
    assert found["counts"].collect()[0].auto_fixable == found["violations"].filter("auto_fixable").count()
    assert jobs.patterns_job(files)["summary"].collect()[0].total_patterns > 0
    assert jobs.architecture_job(files)["metrics"].collect()[0].files == len(TEMPLATES)
