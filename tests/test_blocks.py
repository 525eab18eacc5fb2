"""Blocks of any depth: the bracket index, and the rules that stand on it."""

import random
import time

import pytest

from corpuslode.functions.blocks import Block, Brackets, block_hits
from corpuslode.operators import patterns as pt
from corpuslode.operators.scan import findings
from corpuslode.rules import PATTERNS, security_rules


def deep(depth, inside="x: 1"):
    return "{ a: " * depth + "{ " + inside + " }" + " }" * depth


def brute_pairs(text):
    stack, pairs = [], {}
    for i, c in enumerate(text):
        if c in "([{":
            stack.append(i)
        elif c in ")]}" and stack and text[stack[-1]] + c in ("()", "[]", "{}"):
            pairs[stack.pop()] = i
    return pairs


def brute_outline(text, at, levels):
    pairs = brute_pairs(text)
    if at not in pairs:
        return None
    out, depth, ends = "", 0, []
    for i in range(at, pairs[at] + 1):
        if ends and i == ends[-1]:
            ends.pop()
            depth -= 1
        if depth <= levels:
            out += text[i]
        if i in pairs:
            depth += 1
            ends.append(pairs[i])
    return out


def test_brackets_equal_brute_force():
    pick = random.Random(4)
    for _ in range(3000):
        text = "".join(pick.choices("{}[]()ab,", k=pick.randrange(40)))
        brackets = Brackets(text)
        for at, c in enumerate(text):
            if c in "([{":
                for levels in (1, 2, 3):
                    assert brackets.outline(at, levels) == brute_outline(text, at, levels), (text, at, levels)


def test_brackets_in_strings_are_text():
    text = """{ a: '}', b: "{\\"", c: `}${'`, d: { e: ']' } }"""
    assert Brackets(text).outline(0, 1) == """{ a: '}', b: "{\\"", c: `}${'`, d: {} }"""


@pytest.mark.parametrize("text", [
    "app.get('/a', {" * 20_000, "app.get('/a', { b: " * 20_000 + "}" * 20_000, "app.get('/a', " + deep(20_000) + ")", "x)]}" * 50_000,
    "app.get('/a', { b: 1 })\n" * 20_000, "'" * 100_000, "{" * 100_000 + "app.get('/a', {})"])
def test_the_index_is_linear(text):
    import re

    rule = (re.compile(r"\.(get)\s*\(\s*'[^']*'\s*"), 1, re.compile(r",\s*"), Block())
    started = time.process_time()
    block_hits(text, [rule])
    assert time.process_time() - started < 2


GUARD, SCHEMA = "preHandler: [auth]", "schema: " + deep(20)
# (title, framework, path, texts with a hit, texts without)
CASES = [
    ("Potentially Unprotected Sensitive Route", "node", "a.ts",
     ["app.get('/api/users', h)", "app.get('/api/users', { " + SCHEMA + " }, h)", "app.get('/api/users', { config: { preHandler: 1 } }, h)",
      "app.get(`/private/x`, { a: [{ onRequest: 1 }] }, h)", "app.get('/api/user/middleware', h)"],
     ["app.get('/api/users', { schema: { body: { type: { x: 1 } } }, preHandler: a }, h)", "app.get('/api/users', { " + SCHEMA + ", " + GUARD + " }, h)",
      "app.get('/api/users', { " + SCHEMA + ", async onRequest() {} }, h)", "app.get('/open', h)", "app.get('/api/users', { a: '}', middleware }, h)"]),
    ("Route Without Schema Validation", "fastify", "a.ts",
     ["app.post('/x', h)", "app.put('/x', { config: " + deep(6, "schema: 1") + " }, h)"],
     ["app.post('/x', { schema: { body: { type: 'object', properties: { a: { type: 'string' } } } } }, h)", "app.post('/x', { " + SCHEMA + " }, h)", "app.get('/x', h)"]),
    ("Sensitive Route Without Auth Hook", "fastify", "src/routes/a.ts",
     ["app.get('/admin', h)", "app.get('/admin', { schema: " + deep(9, "preHandler: 1") + " }, h)"],
     ["app.get('/admin', { " + SCHEMA + ", " + GUARD + " }, h)", "app.get('/open', h)"]),
]


@pytest.mark.parametrize("title, framework, path, hits, misses", CASES)
def test_route_rules_hit_and_miss(files, title, framework, path, hits, misses):
    rules = [r for r in security_rules() if r.title == title]
    rows = [(f"{kind}{i}", path, text, framework) for kind, texts in (("hit", hits), ("miss", misses)) for i, text in enumerate(texts)]
    got = {r.project for r in findings(files(*rows), rules).collect()}
    assert got == {f"hit{i}" for i in range(len(hits))}


def test_routes_at_any_depth(files):
    body = """fastify.route({ method: 'POST', url: '/x', schema: { body: { type: 'object', properties: { a: { type: 'string', url: '/no' } } } }, onRequest: f })
fastify.route({ schema: %s, handler: () => { fastify.get('/inner', { config: { schema: 1 } }, h) }, url: '/deep' })
fastify.route(options)
fastify.put('/plain', { preValidation: [a], schema }, h)""" % deep(20, "method: 'NO', preHandler: 1")
    got = {(r.line, r.method, r.route, r.has_schema, r.has_hooks) for r in pt.routes(pt.occurrences(files(("p", "a.ts", body, "fastify")), ["fastify-routes"])).collect()}
    assert got == {(1, "POST", "/x", True, True), (2, "GET", "/deep", True, False), (2, "GET", "/inner", False, False), (4, "PUT", "/plain", True, True)}


def test_messages_and_stores_at_any_depth(files):
    send = "orderProducer.send({ messages: [{ value: %s }], topic: 'a' });\nc.consumer1.subscribe({ topics: ['b', 'c'], x: [[{ topic: 'no' }]] });\nproducer.send(all)" % deep(8, "topic: 'no'")
    store = "defineStore('s', { state: () => ({ n: %s, m: [] }), getters: { g: (s) => f(s.n, { a: { b: 1 } }) }, actions: { add(x) { if (x) { while (y) { z({ q: 1 }) } } }, async clear() {} } })" % deep(9)
    rows = files(("k", "a.ts", send, "fastify"), ("s", "a.ts", store, "vue3"))
    found = pt.occurrences(rows)
    assert {(r.line, r.name, tuple(r.topics)) for r in pt.messaging(found).collect()} == {(1, "orderProducer", ("a",)), (2, "consumer1", ("b", "c")), (3, "producer", ())}
    (r,) = pt.stores(found).collect()
    assert (r.name, r.state, r.getters, r.actions) == ("s", ["n", "m"], ["g"], ["add", "clear"])


def test_block_rules_take_odd_files(files, spark):
    rules = [r for r in security_rules() + PATTERNS if r.block is not None]
    assert len(rules) == 8
    rows = files(("p", "a.ts", None, "fastify"), ("p", "b.ts", "", "fastify"), ("p", "c.ts", "app.get('/api/user', {", "fastify"), ("p", "d.ts", "app.route({", "fastify"),
                 ("p", "e.ts", "// app.get('/api/user', h)", "fastify"), ("p", "f.ts", "app.get('/api/user', " + "{ a: " * 100_000, "fastify"))
    got = {(r.path, r.title) for r in findings(rows, rules).collect()}
    assert got == {(p, t) for p in ("c.ts", "f.ts") for t in ("Potentially Unprotected Sensitive Route", "fastify-routes")}
    assert findings(rows.limit(0), rules).count() == 0
