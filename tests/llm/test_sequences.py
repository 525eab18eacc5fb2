"""Ranked search, periodic runs and BPE by a merge queue, against brute force and the library."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslode.llm import merge_bpe, periodic_runs, queries, ranked_search

JSON = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# BPE


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", " ", "a", "\n", "the", "'re", "é🙂"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\tabthe'séñ漢🙂.,1\x1c\x85​", max_size=60) | SPECIAL)
def test_merges_equal_the_library(library, text):
    own, ids = merge_bpe.loaded(JSON), library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.digest(text) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_merges_of_long_pieces_and_any_ids(library):
    own = merge_bpe.loaded(JSON)
    pick = random.Random(3)
    for text in ("a" * 20_000, "é" * 5000, "".join(pick.choices("abcdefgh", k=30_000)), " " * 5000, "  two  spaces" * 500):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    for _ in range(200):
        ids = [pick.randrange(50_257) for _ in range(pick.randrange(8))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merge_documents(spark, documents, odd, rows, library):
    texts = odd + [" <|endoftext|>a<|endoftext|>", "word " * 200_000] + odd[3:5]
    docs = documents(texts, [None, *range(1, len(odd) + 2), 3, 4])
    got = rows(merge_bpe.digest_documents(docs, JSON))
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for t in texts}
    want = [dict(doc_id=i, n_tokens=len(ids[t]), ids_sha256=sha(",".join(map(str, ids[t]))), decoded_sha256=sha(t or ""))
            for i, t in zip([None, *range(1, len(odd) + 2), 3, 4], texts)]
    assert got == sorted(want, key=lambda r: (r["doc_id"] is not None, r["doc_id"], repr(r)))
    both = merge_bpe.decode_documents(merge_bpe.encode_documents(docs.withColumn("ids", F.lit("old")), JSON), JSON)
    assert both.columns == [*docs.columns, "ids", "decoded"]
    assert all(r["ids"] == ids[r["text"]] and r["decoded"] == (r["text"] or "") and r["_rank"] == "r" for r in both.collect())
    assert merge_bpe.digest_documents(docs.limit(0), JSON).count() == 0


# Runs


def brute_runs(words, shortest=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i + q == len(words) or words[i] != words[i + q]:
                if i - start + q >= max(shortest, times * q):
                    found.setdefault((start, i - start + q), q)
                start = i + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def repeated(pick, size, kinds):
    words = [pick.randrange(kinds) for _ in range(size)]
    for _ in range(pick.randrange(4)):
        if size > 8:
            start = pick.randrange(size - 4)
            period, end = pick.randint(1, max(1, (size - start) // 3)), pick.randint(start, size)
            for i in range(start, end):
                words[i] = words[start + (i - start) % period]
    return words


@pytest.mark.parametrize("block, pairs, shortest, times", [(1 << 20, 1 << 20, 6, 4), (200, 50, 6, 4), (1 << 20, 1 << 20, 1, 3), (100, 20, 9, 5)])
def test_runs_equal_brute_force(monkeypatch, block, pairs, shortest, times):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    pick = random.Random(block + times)
    for _ in range(60):
        texts = [repeated(pick, pick.choice([0, 1, 5, 6, 7, 30, 100, 300]), pick.choice([1, 2, 3, 20])) for _ in range(pick.randint(1, 20))]
        got = periodic_runs.find_runs([np.array(t, np.int32) for t in texts], shortest, times)
        assert [[tuple(map(int, r)) for r in own] for own in got] == [brute_runs(t, shortest, times) for t in texts]


def test_extensions_equal_comparison():
    pick = random.Random(5)
    words = np.array([-1, *[pick.randrange(2) for _ in range(400)], -2, *([7] * 100), -3])
    longest = periodic_runs.Extensions(words)
    pairs = [(i, j) for i, j in (pick.sample(range(len(words)), 2) for _ in range(3000))]
    got = longest(*np.array(pairs).T)
    for (i, j), n in zip(pairs, got):
        want = 0
        while max(i, j) + want < len(words) and words[i + want] == words[j + want]:
            want += 1
        assert n == want


def test_runs_of_very_long_texts_are_quick():
    for words in (np.zeros(200_000, np.int32), np.arange(200_000) % 777):
        (runs,) = periodic_runs.find_runs([words])
        assert len(runs) == 1 and tuple(runs[0][:2]) == (0, 200_000)


def run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    keep = [not any(s + q <= i < s + length for s, length, q in runs) for i in range(n)]
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return dict(doc_id=doc_id, n_runs=len(runs), start=start, length=length, period=period, exponent_milli=1000 * length // period if runs else None,
                runs_sha256=sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), collapsed_sha256=sha(" ".join(w for w, k in zip(words, keep) if k)))


def test_run_query_equals_brute_force(spark, documents, odd, rows, monkeypatch):
    pick = random.Random(2)
    texts = odd + ["\x1cA\x85 b c \x00", "a a a a a a", "x  y\t" * 9 + "z"] + [" ".join(map(str, repeated(pick, pick.randrange(80), pick.choice([2, 30])))) for _ in range(150)]
    ids = [None, *range(1, len(texts) - 1), 7]
    docs = documents(texts, ids)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    want = sorted((run_row(*r) for r in zip(ids, texts)), key=lambda r: (r["doc_id"] is not None, r["doc_id"], repr(r)))
    assert sum(r["n_runs"] > 0 for r in want) > 20
    assert rows(queries.op12_periodic_runs(spark, "")) == want
    docs = docs.limit(0)
    assert queries.op12_periodic_runs(spark, "").count() == 0


def test_collapsed_texts_keep_their_columns(documents):
    docs = documents(["go a b a b a b a b a b on", None]).withColumn("runs", F.lit(1))
    first, second = sorted(periodic_runs.collapse_runs(docs).collect(), key=lambda r: r["doc_id"])
    assert first["collapsed"] == "go a b on" and [tuple(r) for r in first["runs"]] == [(1, 10, 2)] and first["_rank"] == "r"
    assert second["collapsed"] == "" and second["runs"] == []


# Search


def brute_search(docs, items, best):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for (doc, c), size in zip(counts, sizes):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // total)))
                        for t in wanted if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda s: s[:2] + (s[2] or 0,))[:best], 1)]
    return out


def same_search(docs, items, best, owners=4):
    got = [tuple(r) for r in ranked_search.ranked_search(docs, items, best, owners=owners).collect()]
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], best)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_search_equals_brute_force(spark, documents, odd):
    pick = random.Random(6)
    frequent, rare = [f"w{n}" for n in range(8)], [f"r{n}" for n in range(300)]
    texts = odd + ["ÀB cd-EF_gh\x7fz9", "same text here"] + ["same text here"] * 5
    texts += [" ".join(pick.choices(frequent, k=pick.randrange(60)) + pick.choices(rare, k=pick.randrange(8))) for _ in range(400)]
    docs = documents(texts, [None, *range(len(texts), 2, -1), 5]).withColumnRenamed("_rank", "rank")
    items = spark.createDataFrame(
        [(i, " ".join(pick.choices(frequent, k=4) + pick.choices(rare, k=3)), "x") for i in range(25)]
        + [(90, None, "x"), (91, "", "x"), (92, "nowhere", "x"), (None, "SAME, text", "x"), (3, "two rows r1 w1", "x"), (94, "Àb 🙂 the", "x")], "item_id long, text string, term string")
    same_search(docs, items, 50)
    # Few are best and blocks are small, so that documents leave the bundles early.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert len({r[0] for r in same_search(docs, items, 3, owners=7)}) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_in_many_buckets_and_of_empty_tables(spark, documents, monkeypatch):
    monkeypatch.setattr(ranked_search, "BUCKET_ITEMS", 4)
    monkeypatch.setattr(ranked_search, "BROADCAST_ROWS", 0)
    docs = documents([f"a{n % 7} b{n % 3} c" for n in range(60)])
    items = spark.createDataFrame([(i, f"a{i % 9} b{i % 4} c") for i in range(20)], "item_id long, text string")
    same_search(docs, items, 5, owners=2)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (documents([None, " "]), items)):
        found = ranked_search.ranked_search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_filter_knows_every_term(spark):
    terms = [f"t{n}" for n in range(5000)]
    bits = ranked_search.term_filter(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert all(ranked_search.in_filter(bits, t.encode()) for t in terms) and len(bits) == ranked_search.FILTER_BITS // 8
    assert sum(ranked_search.in_filter(bits, f"other{n}".encode()) for n in range(5000)) < 50
