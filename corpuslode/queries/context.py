"""Task and context queries over the code corpus and tasks derived from ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tasks as tk
from ..functions.paths import CONTEXT_EXCLUDE, CONTEXT_INCLUDE, glob_filter, glob_regex
from ..functions.text import TRUNCATION_MARKER
from ..operators import context as cx, facts
from .corpus import code_files, corpus_ctes, quoted, table
from .registry import query

PHRASES = [
    "Fix login error in src/services/api@N@.ts", "Add payment form component", "Refactor user store settings",
    "Document search filter hooks", "Investigate session token upload", "Improve face-id camera screen",
]
BUDGETS, STRATEGIES = [500, 2000, 8000, 50000], ["relevance", "breadth", "depth"]
FOCUS = ["components/"]


def tasks(spark, sf):
    """One task per benchmark item: a phrase, the item's text, a project, a budget, a strategy."""
    i = F.col("item_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    body = F.concat(F.replace(pick(PHRASES), F.lit("@N@"), (i * 7 + i % 7).cast("string")), F.lit(". "), F.col("text"))
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("proj"), (i % 7).cast("string")).alias("project"), i.alias("task_id"), body.alias("task"),
        pick(BUDGETS).alias("max_tokens"), pick(STRATEGIES).alias("strategy"))


def _case(groups) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(task), '{'|'.join(ws)}') THEN '{k}'" for k, ws in groups) + " ELSE 'general' END"


def _in_task(words) -> str:
    return f"list_filter([{', '.join(quoted(w) for w in words)}], lambda w: contains(lower(task), w))"


TASKS_SQL = f"""
tasks AS MATERIALIZED (SELECT 'proj' || (item_id % 7) AS project, item_id AS task_id,
   replace(([{', '.join(quoted(p) for p in PHRASES)}])[item_id % {len(PHRASES)} + 1], '@N@', CAST(item_id * 7 + item_id % 7 AS VARCHAR)) || '. ' || text AS task,
   ([{', '.join(map(str, BUDGETS))}])[item_id % {len(BUDGETS)} + 1] AS max_tokens, ([{', '.join(quoted(s) for s in STRATEGIES)}])[item_id % {len(STRATEGIES)} + 1] AS strategy FROM benchmark),
analysed AS MATERIALIZED (SELECT *, {_case(tk.TASK_KINDS)} AS kind,
   list_filter(list_distinct(regexp_extract_all(lower(task), '\\w{{4,}}')), lambda w: NOT list_contains([{', '.join(quoted(w) for w in tk.STOP_WORDS)}], w)) AS keywords,
   {_in_task(tk.ACTION_VERBS)} AS actions, {_in_task(tk.FRAMEWORK_CONCEPTS)} AS framework_concepts, {_in_task(tk.DOMAIN_CONCEPTS)} AS domain_concepts,
   list_distinct(regexp_extract_all(task, {quoted(tk.MENTION)})) AS mentioned FROM tasks),
budgets AS MATERIALIZED (SELECT *, CAST(floor(max_tokens * CASE strategy WHEN 'relevance' THEN CAST(0.6 AS DOUBLE) WHEN 'breadth' THEN 0.5 ELSE 0.7 END) AS BIGINT) AS budget_files,
   CAST(floor(max_tokens * CASE strategy WHEN 'breadth' THEN CAST(0.2 AS DOUBLE) ELSE 0.15 END) AS BIGINT) AS budget_dependencies,
   CAST(floor(max_tokens * CASE strategy WHEN 'depth' THEN CAST(0.05 AS DOUBLE) ELSE 0.1 END) AS BIGINT) AS budget_tests,
   CAST(floor(max_tokens * CASE strategy WHEN 'breadth' THEN CAST(0.15 AS DOUBLE) WHEN 'relevance' THEN 0.1 ELSE 0.05 END) AS BIGINT) AS budget_architecture,
   CAST(floor(max_tokens * CAST(0.05 AS DOUBLE)) AS BIGINT) AS budget_types FROM analysed)"""

_COUNT = "CAST((length(lc) - length(replace(lc, w, ''))) / length(w) AS BIGINT)"

SCORES_SQL = f"""{TASKS_SQL},
xfiles AS MATERIALIZED (SELECT *, lower(content) AS lc, lower(path) AS lpath, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens, length(content) AS chars,
   contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__') AS is_test
  FROM imported WHERE regexp_matches(path, {quoted(glob_regex(CONTEXT_INCLUDE))}) AND NOT regexp_matches(path, {quoted(glob_regex(CONTEXT_EXCLUDE))})),
pairs AS (SELECT t.*, f.path, f.lc, f.lpath, f.tokens, f.chars, f.is_test FROM budgets t JOIN xfiles f USING (project)),
scores AS MATERIALIZED (SELECT project, task_id, path, tokens, chars, is_test,
   CAST(CASE WHEN len(list_filter(mentioned, lambda m: contains(path, m))) > 0 THEN 100 ELSE 0 END
   + CASE WHEN contains(path, 'components/') THEN 50 ELSE 0 END
   + coalesce(list_sum(list_transform(keywords, lambda w: CASE WHEN contains(lpath, w) THEN 15 ELSE 0 END + least({_COUNT} * 2, 20))), 0)
   + coalesce(list_sum(list_transform(domain_concepts, lambda w: CASE WHEN contains(lpath, w) THEN 20 ELSE 0 END + least({_COUNT} * 3, 30))), 0)
   + coalesce(list_sum(list_transform(framework_concepts, lambda w: CASE WHEN contains(lpath, w) THEN 10 ELSE 0 END)), 0)
   + CASE WHEN is_test AND (kind = 'bug' OR contains(lc, 'test')) THEN 15 ELSE 0 END AS BIGINT) AS score FROM pairs)"""


def _fold(name, ranked, budget, category, stop) -> str:
    """Recursive packing of ``ranked`` (project, task_id, rank, path, score, tokens) into ``budget``."""
    left = "(w.b - w.used)"
    take = f"CASE WHEN r.tokens > {left} THEN CAST(ceil((floor({left} * 4 * CAST(0.6 AS DOUBLE)) + floor({left} * 4 * CAST(0.2 AS DOUBLE)) + {len(TRUNCATION_MARKER)}) / 4) AS BIGINT) ELSE r.tokens END"
    return f"""
{name}_walk(project, task_id, b, rank, used, path, score, tokens, truncated) AS (
  SELECT project, task_id, {budget}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM budgets
  UNION ALL SELECT w.project, w.task_id, w.b, r.rank, w.used + {take}, r.path, r.score, {take}, r.tokens > {left}
  FROM {name}_walk w JOIN {ranked} r ON r.project = w.project AND r.task_id = w.task_id AND r.rank = w.rank + 1 WHERE NOT ({stop})),
{name} AS MATERIALIZED (SELECT project, task_id, '{category}' AS category, path, score, CAST(rank AS INT) AS rank, tokens, truncated FROM {name}_walk WHERE rank > 0)"""


def _pack_sql(dependencies: str = "") -> str:
    """``dependencies`` says which of a task's ranked dependencies are packed at all."""
    return f"""{SCORES_SQL},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project, task_id ORDER BY score DESC, path) AS rank FROM scores),
{_fold('prim', 'ranked', 'budget_files', 'primary', 'w.used >= w.b OR w.used > w.b * CAST(0.9 AS DOUBLE)')},
imps AS (SELECT project, path, unnest(import_sources) AS source, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM xfiles),
keys AS (SELECT *, CASE WHEN starts_with(source, './') THEN dir || '/' || source[3:] WHEN starts_with(source, '../') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) || '/' || source[4:] END AS key FROM imps WHERE starts_with(source, '.')),
tries AS (SELECT p.project, p.task_id, k.key, s.priority, k.key || s.suffix AS target FROM prim p JOIN keys k USING (project, path), (VALUES (1,'.ts'),(2,'.tsx'),(3,'.js'),(4,'.jsx'),(5,'.vue')) s(priority, suffix)),
deps AS (SELECT DISTINCT project, task_id, target AS path FROM (SELECT t.project, task_id, key, min_by(target, priority) AS target FROM tries t JOIN xfiles x ON x.project = t.project AND x.path = t.target GROUP BY ALL)),
dranked AS MATERIALIZED (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY project, task_id ORDER BY score DESC, path) AS rank FROM scores s JOIN deps USING (project, task_id, path)){dependencies}),
{_fold('dep', 'dranked', 'budget_dependencies', 'dependency', 'w.used >= w.b')},
tranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project, task_id ORDER BY score DESC, path) AS rank FROM scores s
   WHERE is_test AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.project = s.project AND p.task_id = s.task_id AND p.path = s.path)
     AND NOT EXISTS (SELECT 1 FROM dep p WHERE p.project = s.project AND p.task_id = s.task_id AND p.path = s.path)),
{_fold('tst', 'tranked', 'budget_tests', 'test', 'w.used >= w.b')},
packed AS MATERIALIZED (SELECT * FROM prim UNION ALL SELECT * FROM dep UNION ALL SELECT * FROM tst)"""


# Fixed value of the queries built on packs: dependencies of a task. ``context_packs`` has no such bound.
DEPENDENCIES = 10
PACK_SQL = _pack_sql(f" WHERE rank <= {DEPENDENCIES}")


def _files(spark, sf):
    return glob_filter(code_files(spark, sf), CONTEXT_INCLUDE, CONTEXT_EXCLUDE)


def _pack(spark, sf, dependency_limit=DEPENDENCIES):
    files = _files(spark, sf)
    return cx.context_pack(files, tasks(spark, sf), facts.import_rows(files), FOCUS, dependency_limit=dependency_limit)


@query("P24 P25 W13", f"""WITH {TASKS_SQL}
SELECT project, task_id, kind, array_to_string(list_sort(keywords), ',') AS keywords, array_to_string(actions, ',') AS actions, array_to_string(framework_concepts, ',') AS framework_concepts,
 array_to_string(domain_concepts, ',') AS domain_concepts, array_to_string(mentioned, ',') AS mentioned, budget_files, budget_dependencies, budget_tests, budget_architecture, budget_types FROM budgets""")
def task_analysis(spark, sf):
    rows = cx.allocate_budget(cx.analyse_tasks(tasks(spark, sf)))
    text = [F.array_join(c, ",").alias(c) for c in ("actions", "framework_concepts", "domain_concepts", "mentioned")]
    return rows.select("project", "task_id", "kind", F.array_join(F.array_sort("keywords"), ",").alias("keywords"), *text,
                       "budget_files", "budget_dependencies", "budget_tests", "budget_architecture", "budget_types")


@query("J7 X1 X3", lambda: f"""WITH {corpus_ctes('imports')}, {SCORES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY project, task_id ORDER BY score DESC, path) AS rank FROM scores)
SELECT project, task_id, path, score, tokens, CAST(rank AS INT) AS rank FROM k WHERE rank <= 25""")
def relevance_ranking(spark, sf):
    """The 25 most relevant files of every task."""
    files = _files(spark, sf)
    analysed = cx.analyse_tasks(tasks(spark, sf))
    best = cx.candidates(cx.matched_scores(files, analysed, FOCUS), cx.file_base(files, FOCUS), analysed, 25)
    return best.select("project", "task_id", "path", "score", "tokens", "rank")


@query("X2", lambda: f"""WITH {corpus_ctes('imports')}, {SCORES_SQL},
t AS (SELECT project, task_id, unnest(list_concat(list_concat(list_transform(keywords, lambda w: {{'g': 'keyword', 'w': w}}), list_transform(domain_concepts, lambda w: {{'g': 'domain', 'w': w}})),
   list_transform(framework_concepts, lambda w: {{'g': 'framework', 'w': w}}))) AS s FROM budgets),
u AS (SELECT project, task_id, s.g AS grp, s.w AS w FROM t)
SELECT u.project, task_id, path, grp AS "group", w AS term, contains(lpath, w) AS in_path, {_COUNT} AS n FROM u JOIN xfiles USING (project) WHERE contains(lpath, w) OR contains(lc, w)""")
def relevance_reasons(spark, sf):
    """Why a file is relevant: every term that its path or text holds, and how often."""
    terms = cx.task_terms(cx.analyse_tasks(tasks(spark, sf)))
    return cx.term_points(cx.term_matches(_files(spark, sf), terms), terms).drop("points")


@query("W14 J8 J9 X4", lambda: f"WITH RECURSIVE {corpus_ctes('imports')}, {_pack_sql()} SELECT project, task_id, category, path, score, rank, tokens, truncated FROM packed")
def context_packs(spark, sf):
    return _pack(spark, sf, None)


@query("A30", lambda: f"""WITH RECURSIVE {corpus_ctes('imports')}, {PACK_SQL},
u AS (SELECT project, task_id, CAST(coalesce(sum(tokens) FILTER (category='primary'), 0) AS BIGINT) AS primary_tokens, CAST(coalesce(sum(tokens) FILTER (category='dependency'), 0) AS BIGINT) AS dependency_tokens,
  CAST(coalesce(sum(tokens) FILTER (category='test'), 0) AS BIGINT) AS test_tokens, CAST(0 AS BIGINT) AS type_tokens, CAST(sum(tokens) AS BIGINT) AS used, count(*) AS files, avg(score) AS avg_score FROM packed GROUP BY project, task_id)
SELECT project, task_id, max_tokens, primary_tokens, dependency_tokens, test_tokens, type_tokens, used, files, avg_score, max_tokens - used AS remaining FROM budgets JOIN u USING (project, task_id)""")
def context_budget_use(spark, sf):
    return cx.budget_use(_pack(spark, sf), tasks(spark, sf))


@query("W15", lambda: f"""WITH RECURSIVE {corpus_ctes('imports')}, {PACK_SQL},
s AS (SELECT *, sum(tokens) OVER (PARTITION BY project, task_id) AS total, CAST(floor(tokens * (1000 / CAST(sum(tokens) OVER (PARTITION BY project, task_id) AS DOUBLE))) AS BIGINT) AS aim FROM packed)
SELECT project, task_id, category, path, tokens, CAST(CASE WHEN total <= 1000 THEN tokens WHEN tokens * 4 <= aim * 4 THEN tokens
  ELSE ceil((floor(aim * 4 * CAST(0.6 AS DOUBLE)) + floor(aim * 4 * CAST(0.2 AS DOUBLE)) + {len(TRUNCATION_MARKER)}) / 4) END AS BIGINT) AS shrunk_tokens FROM s""")
def context_shrunk_packs(spark, sf):
    return cx.shrink_to(_pack(spark, sf), 1000).select("project", "task_id", "category", "path", "tokens", "shrunk_tokens")


def _seen_sql() -> str:
    tests = [f"CASE WHEN {' OR '.join(f'contains(content, {quoted(w)})' for w in ws)} THEN {quoted(n)} END" for n, ws in cx.PROJECT_PATTERNS]
    tests.append("CASE WHEN contains(content, 'async') AND contains(content, 'await') THEN 'Async/Await' END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


@query("A33", lambda: f"""WITH RECURSIVE {corpus_ctes('imports')}, {PACK_SQL},
n AS (SELECT project, path, unnest({_seen_sql()}) AS pattern FROM xfiles)
SELECT project, task_id, pattern, count(*) AS files FROM (SELECT DISTINCT project, task_id, path FROM packed) JOIN n USING (project, path) GROUP BY ALL""")
def context_pack_patterns(spark, sf):
    return cx.pack_patterns(_pack(spark, sf), _files(spark, sf))
