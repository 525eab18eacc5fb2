"""Byte-level BPE, packing and toxicity."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslode.llm import byte_bpe, packing, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\tabthe'séñ漢🙂.,1", max_size=60))
def test_bpe_equals_the_library(library, text):
    own = byte_bpe.loaded(RANKS, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_on_long_pieces_is_exact_and_quick(library):
    own = byte_bpe.loaded(RANKS, public_tokenizers.PATTERN)
    random.seed(3)
    for text in ("a" * 20_000, "é" * 5000, "".join(random.choices("abcdefgh", k=30_000)), " " * 5000, "<|endoftext|>"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_bpe_documents(spark, documents, odd, rows, library):
    docs = documents(odd + odd[3:5], [None] + list(range(1, len(odd))) + [3, 4])
    for r in byte_bpe.digest_documents(docs, RANKS, public_tokenizers.PATTERN).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both.collect())
    assert byte_bpe.digest_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(spark, documents, odd):
    random.seed(1)
    texts = odd + [" ".join(random.choices("one two three <|endoftext|> vier fünf".split(), k=random.randint(1, 900))) for _ in range(150)] + ["copy of this"] * 60
    docs = documents(texts + ["twice"], list(range(len(texts))) + [0])
    got = packing.pack_documents(docs, JSON, 0, 256).collect()
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], i, len(ids[i:i + 256]), zlib.crc32(np.array(ids[i:i + 256], "<u4").tobytes()), len(ids)) for i in range(0, len(ids), 256)]
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in got) > 0.97 * 256 * (len(sequences) - 1)
    assert packing.pack_documents(docs.limit(0), JSON).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.solve_patterns(histogram, 64)
    held = collections.Counter()
    for times, parts in patterns:
        assert times > 0 and sum(length * n for length, n in parts) <= 64
        for length, n in parts:
            held[length] += times * n
    assert held == collections.Counter(histogram)


def test_knapsack_is_the_best():
    lengths, prices = np.array([3, 4, 7, 9]), np.array([0.3, 0.45, 0.7, 1.05])
    best = max(a * 0.3 + b * 0.45 + c * 0.7 + d * 1.05 for a in range(7) for b in range(6) for c in range(3) for d in range(3) if 3 * a + 4 * b + 7 * c + 9 * d <= 20)
    price, column = packing.best_pattern(lengths, prices, 20)
    assert abs(price - best) < 1e-9 and column @ lengths <= 20 and abs(column @ prices - best) < 1e-9


def test_toxicity_learns_and_generalises(spark, documents, odd):
    random.seed(4)
    plain = "the of and house tree road walk green light water stone bread under over many few".split()
    rude = "grobian lump schuft".split()

    def text(bad):
        words = random.choices(plain, k=random.randint(20, 200))
        for _ in range(max(2, len(words) // 40) if bad else 0):
            words[random.randrange(len(words))] = random.choice(rude)
        return " ".join(words)

    truth = [i % 5 == 0 for i in range(400)]
    docs = documents([text(t) for t in truth] + odd)
    labels = spark.createDataFrame([(i, int(t), 1) for i, t in enumerate(truth)] + [(0, 1, 1), (None, 1, 1), (999, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.withColumn("score", F.lit("old")), model).collect()}
    held = [i for i in range(400) if i % 4 == 2]
    assert sum((got[i]["predicted"] == 1) == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert len({got[i]["score"] for i in (400, 401, 402)}) == 1
    neutral = toxicity.fit_toxicity(docs, labels.limit(0), F.lit(True))
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(docs, neutral).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxic_phrase_of_neutral_words(documents):
    pick = random.Random(8)
    texts, truth = [], []
    for i in range(400):
        words = pick.choices(["one", "two", "three", "four", "five", "six"], k=20)
        truth.append(i % 4 == 0)
        words[3:3], words[12:12] = (["green", "idea"], ["idea"]) if truth[-1] else (["idea", "green"], ["idea"])
        texts.append(" ".join(words))
    labels = documents(texts).sparkSession.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(documents(texts), labels, F.col("doc_id") < 300)
    ratio = dict(zip(model.words, model.word_ratio))
    key = model.words[b"green"] * len(model.words) + model.words[b"idea"]
    assert abs(ratio[b"green"]) < 1e-9 and model.bigram_ratio[list(model.bigram_keys).index(key)] > 1
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(documents(texts), model).collect()}
    assert all(got[i] == truth[i] for i in range(300, 400))
