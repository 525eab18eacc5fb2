"""Near duplicates, fingerprints, the language model and the pipeline."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslode.llm import fingerprints, gru, language_model, near_duplicates, packing
from corpuslode.llm.common import id_crc

random.seed(11)
VOCABULARY = ["".join(random.choices("abcdefghijkl", k=random.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def edited(text, edits, seed):
    words, pick = text.split(), random.Random(seed)
    for _ in range(edits):
        words[pick.randrange(len(words))] = "edit" + str(pick.random())[2:6]
    return " ".join(words)


def shingles(text, k):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", " ".join(words))]
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    nodes = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=repr)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(documents, odd, k, percent):
    texts = list(odd)
    for base in range(12):
        text = prose(120, base)
        texts += [text, text.upper(), text]
        texts += [edited(text, e, 10 * base + e) for e in range(1, 9)]
        chain = text
        for step in range(4):  # each close to the one before, the ends far apart
            chain = edited(chain, 2, 1000 + 10 * base + step)
            texts.append(chain)
    texts += [prose(100, 3) + " " + prose(100, 4), "one two", "one  TWO"]
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    docs = documents(texts + [texts[9], texts[20], "null id"], order + [order[9], order[20], None])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(docs, k, percent).collect()), key=repr)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], k, percent)


def _family(pick, base, copies, edits):
    """Copies of a text with single words replaced at random places."""
    out = []
    for _ in range(copies):
        words = list(base)
        for at in pick.sample(range(len(words)), edits):
            words[at] = f"w{pick.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def _sets(texts, k):
    return [set(zip(*[t.split()[i:] for i in range(k)])) for t in texts]


def _alike(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


@pytest.mark.parametrize("edits", [3, 5, 6, 8])
def test_candidates_of_a_large_family_grow_with_its_size(spark, edits):
    """Copies of 100 words whose source is not there: pairs at the threshold (3 edits) and below it (5, 6, 8)."""
    pick = random.Random(edits)
    base = [f"b{i}" for i in range(100)]
    count = {}
    for n in (200, 400):
        texts = _family(pick, base, n, edits)
        hashes = [near_duplicates.shingle_set(t.encode(), 3) for t in texts]
        rows = [(i.to_bytes(16, "big"), i.to_bytes(16, "big"), h.view("int64").tolist()) for i, h in enumerate(hashes)]
        made = spark.createDataFrame(rows, "members binary, component binary, hashes array<bigint>")
        got = {tuple(sorted((int.from_bytes(r.u, "big"), int.from_bytes(r.v, "big")))) for r in near_duplicates.rare_partners(made, 85).collect()}
        sets = _sets(texts, 3)
        linked = {(i, j) for i in range(n) for j in range(i + 1, n) if _alike(sets[i], sets[j], 85)}
        assert linked <= got
        count[n] = len(got) - len(linked)
    if edits > 3:
        assert count[400] <= 400
    else:  # pairs of copies lie at the threshold itself, so some must be compared
        assert all(c <= 0.02 * n * (n - 1) / 2 for n, c in count.items())


def test_links_around_the_threshold_are_found(spark, documents):
    """Recall over all links of families around the threshold: both ends stand in one component."""
    pick, texts = random.Random(5), []
    for edits in (1, 2, 3, 5):
        base = [f"x{edits}_{i}" for i in range(90)]
        texts += [" ".join(base), *_family(pick, base, 30, edits)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(documents(texts), 3, 85).collect()}
    sets = _sets(texts, 3)
    links = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if _alike(sets[i], sets[j], 85)]
    assert len(links) > 100
    assert sum(got[i] == got[j] for i, j in links) == len(links)
    # Nothing else is put together: components are those of the links.
    home = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            home[i] = home[j] = min(home[i], home[j])
    assert [got[i] for i in range(len(texts))] == home


def test_near_duplicates_of_nothing(documents):
    assert near_duplicates.near_duplicates(documents([])).count() == 0
    assert {r["component_id"] for r in near_duplicates.near_duplicates(documents(["", None])).collect()} == {0, 1}


def test_estimate_follows_the_similarity(spark):
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            both, left, right = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (int(1000 * share), int(500 * (1 - share)), int(500 * (1 - share))))
            a, b = np.unique(np.concatenate([both, left])), np.unique(np.concatenate([both, right]))
            rows = [(near_duplicates.signature(a)[0].tolist(), near_duplicates.signature(b)[0].tolist())]
            errors.append(rows[0])
        df = spark.createDataFrame(errors, "p array<bigint>, q array<bigint>")
        mean = df.select(F.avg(near_duplicates.estimate(F.col("p"), F.col("q")))).first()[0]
        assert abs(mean - share) < 0.04


def test_fingerprints_are_homomorphic(spark):
    rows = [("One here. Two there.\nThree.\nFour?", "Four?\nThree.\nOne here. Two there.", "Three.", "One here. Two there.\nFour?")]
    df = spark.createDataFrame(rows, "a string, b string, part string, rest string")
    h = {c: fingerprints.multiset_hash(F.col(c)) for c in df.columns}
    got = df.select((h["a"] == h["b"]).alias("order"), (fingerprints.combine(h["rest"], h["part"]) == h["a"]).alias("insert"),
                    (fingerprints.combine(h["a"], h["part"], -1) == h["rest"]).alias("remove"), (h["a"] == h["rest"]).alias("differ"),
                    fingerprints.likeness(h["a"], h["b"]).alias("one")).first()
    assert got["order"] and got["insert"] and got["remove"] and not got["differ"] and got["one"] == 1.0


def test_edited_fingerprints(documents, odd):
    long = [". ".join(prose(8, 100 * i + j) for j in range(40)) for i in range(6)]
    texts = odd + long + [long[0]]
    docs = documents(texts + [long[1], "null id text"], [i * 3 for i in range(len(texts))] + [3 * (len(odd) + 1), None])
    got = fingerprints.edited_fingerprints(docs).collect()
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(i for i in by_id if i is not None)
    assert len(got) == len(texts) + 2
    for r in got:
        text = by_id[r["doc_id"]]
        n = len(text) // 4
        follows = by_id[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]] if r["doc_id"] is not None else ""
        new = text[:len(text) - n] + follows[:n]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if text in long:
            assert r["near_edited"] > 0.5 > r["near_next"] or follows == text
    prints = collections.defaultdict(set)
    for r in got:
        prints[by_id[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({r["fingerprint"] for r in got if by_id[r["doc_id"]] in long}) == len(long)
    assert fingerprints.edited_fingerprints(documents([])).count() == 0


def test_gradient_is_the_slope_of_the_loss():
    shape = gru.Shape(7, 3, per_class=3, embedding=4, state=5)
    rng = np.random.default_rng(0)
    vector = gru.first_parameters(shape, rng.integers(1, 9, 10).astype(float))
    documents = [rng.integers(0, 10, rng.integers(1, 14)).astype(np.int32) for _ in range(12)]
    window = next(iter(gru.lanes(documents, shape)))
    slope, _, count = gru.Gru(vector, shape).gradient(*window, np.zeros((window[0].shape[1], 5), np.float32))
    whole = [d for d in range(12) if (window[2] == d).sum() == len(documents[d])]
    assert whole and count == (window[2] >= 0).sum()
    if len(whole) == len(documents):
        def loss(v):
            return -gru.Gru(v, shape).log10_of(documents).sum() * math.log(10) / count
        for i in rng.integers(0, len(vector), 40):
            up, down = vector.copy(), vector.copy()
            up[i] += 0.02
            down[i] -= 0.02
            assert abs((loss(up) - loss(down)) / 0.04 - slope[i]) < 2e-3


def test_every_training_symbol_gives_a_gradient():
    shape = gru.Shape(20, 4, per_class=5)
    rng = np.random.default_rng(3)
    documents = [rng.integers(0, 24, n).astype(np.int32) for n in (300, 1, 65, 0, 40, 129)]
    trainer = gru.Trainer(gru.first_parameters(shape, np.ones(24)), shape)
    trainer.learn(documents)
    assert trainer.symbols == sum(map(len, documents))


def test_windows_reuse_their_arrays_and_a_state_outlives_them():
    shape = gru.Shape(20, 4, per_class=5)
    rng = np.random.default_rng(3)
    model = gru.Gru(gru.first_parameters(shape, np.ones(24)), shape)
    windows = list(gru.lanes([rng.integers(0, 24, 70) for _ in range(6)], shape))
    state = np.zeros((windows[0][0].shape[1], shape.state), np.float32)
    slope, last, _ = model.gradient(*windows[0], state)
    held, kept, first = {name: id(model.spaces[name]) for name in ("given", "states", "before", "gates", "logits", "back")}, last.copy(), slope.copy()
    model.gradient(*windows[1], last)
    assert held == {name: id(model.spaces[name]) for name in held}
    assert (last == kept).all() and (model.gradient(*windows[0], state)[0] == first).all()


def test_state_carries_through_a_document_and_no_further():
    shape = gru.Shape(20, 4, per_class=5)
    model = gru.Gru(gru.first_parameters(shape, np.ones(24)), shape)
    rng = np.random.default_rng(2)
    documents = [rng.integers(0, 24, n).astype(np.int32) for n in (100, 1, 3, 40, 0, 77)]
    together = model.log10_of(documents)
    apart = [model.log10_of([d])[0] for d in documents]
    assert np.allclose(together, apart, atol=1e-3) and together[4] == 0


def test_language_model(documents, odd, monkeypatch):
    monkeypatch.setattr(language_model, "KNOWN", 60)
    monkeypatch.setattr(language_model, "FREQUENT", 40)
    monkeypatch.setattr(language_model, "COUNTED", 50)
    tongues = [VOCABULARY[:200], VOCABULARY[200:]]
    texts = odd + [" ".join(random.Random(i).choices(tongues[i % 2], k=60)) for i in range(240)]
    docs = documents(texts + [texts[10]], list(range(len(texts))) + [10])
    got = language_model.score_documents(docs, id_crc("doc_id") % 10 != 0).collect()
    assert len(got) == len(texts) + 1
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in docs.collect()}
    counts = collections.Counter()
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            counts.update(tokens[r["doc_id"]])
    total, distinct = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own) and r["train_tokens"] == total
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)) < 1e-6
        assert r["score"] < 0
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in held) > 1.01 * sum(r["base_score"] for r in held)  # few updates on so few words
    nothing = language_model.score_documents(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["base_score"]) for r in nothing)
    assert language_model.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages(spark, documents, tmp_path):
    clean = [prose(60, 500 + i) for i in range(30)]
    docs = documents(clean + [clean[0], edited(clean[1], 1, 3), "too short", None, "a b c d e f g h " * 20]).select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(i, 0, 1) for i in range(20)], "doc_id long, toxic int, quality int").write.parquet(folder + "/labels.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == set(range(32))
    safe = corpus_pipeline.toxicity_stage(spark, kept, folder)
    assert safe.columns == columns and safe.count() == 32
    single = corpus_pipeline.near_duplicate_stage(spark, safe, folder)
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == set(range(30))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(range(30))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]


class Tasks:
    """Stands for a table; gives the function that tasks run on its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_a_worker_keeps_no_tables_of_an_earlier_stage(spark):
    texts = [" ".join(f"a{i}x{k}" for k in range(1000)) for i in range(40)]

    def batch(kind):
        return iter([pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts).cast(kind)], names=["doc_id", "text"])])

    pieces = packing.token_pieces(Tasks(), public_tokenizers.path("byte_bpe_50k.json"), 0, 1024)
    signed = near_duplicates.signatures(Tasks(), 5)
    tracemalloc.start()
    try:
        list(pieces(batch(pa.string())))
        held = tracemalloc.get_traced_memory()[0]
        list(signed(batch(pa.binary())))
        left = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held > 4_000_000  # ids of 40,000 units, used again by later tasks of the same stage
    assert left < 1_000_000


def test_near_duplicate_stage_with_repeated_and_null_ids(spark, documents):
    z, a, b = prose(80, 901), prose(80, 902), prose(80, 903)
    docs = documents([z, z, a, a, b, b, z, a], [1, 3, 3, 9, None, None, 1, None]).select("doc_id", "text", "lang", "source", "n_chars")
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == {(1, z): 1, (3, a): 1, (None, b): 1}
