import math
import random
import re

import pytest

from corpuslode.functions import tasks as tk
from corpuslode.functions.text import TRUNCATION_MARKER
from corpuslode.operators import context as cx, facts
from corpuslode.queries import context as queries, load

FILES = [(f"p", f"src/{d}/{n}{i}{e}", body * (i + 1)) for i in range(4) for d, n, e, body in [
    ("services", "login", ".ts", "import x from './user0';\nlogin user token loginlogin\n" * 6), ("services", "user", ".ts", "user store error search\n" * 9),
    ("components", "Card", ".tsx", "render card payment\n" * 5), ("utils", "fmt", ".test.ts", "describe user test error\n" * 4), ("misc", "zzz", ".ts", "nothing here\n" * 3)]]
TASKS = [("p", 1, "Fix login error in src/services/login1.ts", 300, "relevance"), ("p", 2, "Add payment card form", 900, "depth"), ("p", 3, "Explain zebra", 60, "breadth")]


def _score(task, path, text):
    low, words = task.lower(), [w for w in dict.fromkeys(re.findall(r"\w{4,}", task.lower(), re.A)) if w not in tk.STOP_WORDS]
    kind = next((k for k, ws in tk.TASK_KINDS if any(w in low for w in ws)), "general")
    p, t, score = path.lower(), text.lower(), 0
    score += 100 if any(m in path for m in re.findall(tk.MENTION, task)) else 0
    score += sum(15 * (w in p) + min(2 * t.count(w), 20) for w in words)
    score += sum(20 * (w in p) + min(3 * t.count(w), 30) for w in tk.DOMAIN_CONCEPTS if w in low)
    score += sum(10 * (w in p) for w in tk.FRAMEWORK_CONCEPTS if w in low)
    test = any(m in path for m in (".test.", ".spec.", "__tests__"))
    return score + (15 if test and (kind == "bug" or "test" in t) else 0)


def _cut(text, tokens):
    chars = tokens * 4
    if len(text) <= chars:
        return text
    tail = math.floor(chars * 0.2)
    return text[: math.floor(chars * 0.6)] + TRUNCATION_MARKER + (text[len(text) - tail:] if tail else "")


def _loop(ranked, budget, stop_share=None):
    used, out = 0, []
    for path, text in ranked:
        if used >= budget:
            break
        body = _cut(text, budget - used) if math.ceil(len(text) / 4) > budget - used else text
        tokens = math.ceil(len(body) / 4)
        used += tokens
        out.append((path, tokens))
        if stop_share and used > budget * stop_share:
            break
    return out


def test_packs_equal_a_plain_loop(spark):
    files = spark.createDataFrame(FILES, "project string, path string, content string")
    tasks = spark.createDataFrame(TASKS, "project string, task_id int, task string, max_tokens int, strategy string")
    got = {}
    for r in cx.context_pack(files, tasks, facts.import_rows(files)).collect():
        got.setdefault((r.task_id, r.category), []).append((r.rank, r.path, r.tokens))
    text = {path: body for _, path, body in FILES}
    for _, tid, task, most, strategy in TASKS:
        shares = cx.SHARES[strategy]
        ranked = sorted(text, key=lambda p: (-_score(task, p, text[p]), p))
        primary = _loop([(p, text[p]) for p in ranked], math.floor(most * shares["files"]), 0.9)
        assert [(p, t) for _, p, t in sorted(got[tid, "primary"])] == primary
        wanted = {"src/services/user0.ts"} if any("login" in p for p, _ in primary) else set()
        deps = _loop([(p, text[p]) for p in ranked if p in wanted], math.floor(most * shares["dependencies"]))
        assert [(p, t) for _, p, t in sorted(got.get((tid, "dependency"), []))] == deps
        chosen = {p for p, _ in primary + deps}
        tests = _loop([(p, text[p]) for p in ranked if ".test." in p and p not in chosen], math.floor(most * shares["tests"]))
        assert [(p, t) for _, p, t in sorted(got.get((tid, "test"), []))] == tests


def test_mentions_of_a_path(spark):
    from pyspark.sql import functions as F
    got = spark.range(1).select(tk.mentions_of_path(F.lit("my/src/app/a-b.test.ts")).alias("v")).collect()[0].v
    assert "src/app/a-b.test" in got and "app/a-b.t" in got and "src/app/a-b" not in got
    for mention in got:
        assert re.fullmatch(tk.MENTION, mention) and mention in "my/src/app/a-b.test.ts"


def test_dependencies_are_bounded_by_their_budget_alone(spark):
    names = [f"part{i:02d}" for i in range(25)]
    main = "".join(f"import {n} from './{n}';\n" for n in names) + "login " * 2000
    rows = [("p", "src/login.ts", main)] + [("p", f"src/{n}.ts", f"export const {n} = 1;") for n in names]
    files = spark.createDataFrame(rows, "project string, path string, content string")
    tasks = spark.createDataFrame([("p", 1, "Fix login error in src/login.ts", 3000, "relevance")], "project string, task_id int, task string, max_tokens int, strategy string")

    def packed(**bound):
        rows = cx.context_pack(files, tasks, facts.import_rows(files), **bound).filter("category = 'dependency'")
        return sorted(r.path for r in rows.collect())

    assert packed() == [f"src/{n}.ts" for n in names]
    assert packed(dependency_limit=10) == [f"src/{n}.ts" for n in names[:10]]


def test_query_packs_all_dependencies_that_the_budget_holds(spark, monkeypatch):
    names = [f"part{i:02d}" for i in range(14)]
    main = "".join(f"import {n} from './{n}';\n" for n in names) + "login " * 2000
    rows = [("p", "src/login.ts", main)] + [("p", f"src/{n}.ts", f"export const {n} = 1;") for n in names]
    monkeypatch.setattr(queries, "_files", lambda spark, _: spark.createDataFrame(rows, "project string, path string, content string"))
    monkeypatch.setattr(queries, "tasks", lambda spark, _: spark.createDataFrame(
        [("p", 1, "Fix login error in src/login.ts", 3000, "relevance")], "project string, task_id int, task string, max_tokens int, strategy string"))
    found = load()["context_packs"].run(spark, "").filter("category = 'dependency'").collect()
    assert sorted((r.path, r.rank) for r in found) == [(f"src/{n}.ts", i) for i, n in enumerate(names, 1)]
    assert "rank <= 10)" not in load()["context_packs"].sql() and "rank <= 10)" in load()["context_budget_use"].sql()


@pytest.mark.parametrize("most", [200_000, 0])
def test_term_matches_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(cx, "INDEX_WORDS", most)
    pick = random.Random(most)
    words = ["login", "loginlogin", "relogin", "aaa", "aaaaaaa", "xaaay", "token_store", "face-id", "Naïve", "user", "us", "ab" * 30]
    files = [(f"p{i % 3}", f"src/{pick.choice(words)}/{i}.ts", " ".join(pick.choices(words, k=pick.randrange(30)))) for i in range(60)] + [("p0", "src/none.ts", None), ("p0", "", "")]
    terms = [(f"p{i % 3}", i, "keyword", t) for i, t in enumerate(["login", "aaa", "oken_st", "user", "absent", "na", "face-id", "abab", "login", "e"] * 2)]
    got = cx.term_matches(spark.createDataFrame(files, "project string, path string, content string").repartition(4),
                          spark.createDataFrame(terms, "project string, task_id int, group string, term string"))
    want = set()
    for project, path, text in files:
        for term in {t for p, _, _, t in terms if p == project}:
            # Plain terms are looked for in words, face-id as it stands.
            found = [w.count(term) for w in re.findall(r"\w+", (text or "").lower(), re.A)] if re.fullmatch(r"\w+", term) else [(text or "").lower().count(term)]
            if sum(found) or term in path.lower():
                want.add((project, path, term, term in path.lower(), sum(found)))
    assert {tuple(r) for r in got.select("project", "path", "term", "in_path", "n").collect()} == want and len(want) > 100
    none = spark.createDataFrame([], "project string, task_id int, group string, term string")
    assert cx.term_matches(spark.createDataFrame(files, "project string, path string, content string"), none).count() == 0


def test_few_terms_are_counted_where_the_text_lies(spark, monkeypatch):
    """No index of the vocabulary is made; repeated files, nulls, long words and words beyond the memory of a task count as before."""
    def refuse(*_):
        raise AssertionError("the vocabulary was indexed")

    monkeypatch.setattr(cx, "term_index", refuse)
    monkeypatch.setattr(cx, "WORDS_KEPT", 2)
    rows = [("p", "src/user.ts", "User users xuserx map maps"), ("p", "src/user.ts", "user"), ("p", None, "user"), (None, "a", "user"), ("q", "user", "user"),
            ("p", "src/MAP/b.ts", None), ("p", "c", "ab" * 500 + " Naïve"), ("p", "d", "")]
    files = spark.createDataFrame(rows, "project string, path string, content string")
    asked = spark.createDataFrame([("p", "user"), ("p", "map"), ("p", "abab"), ("p", "ve"), ("p", "user"), (None, "user")], "project string, term string")
    got = {tuple(r) for r in cx.term_postings(files, asked).collect()}
    assert got == {("p", "src/user.ts", "user", True, 4), ("p", "src/user.ts", "map", False, 2), ("p", None, "user", False, 1),
                   ("p", "src/MAP/b.ts", "map", True, 0), ("p", "c", "abab", False, 250), ("p", "c", "ve", False, 1)}
