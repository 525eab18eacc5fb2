"""Sharding, quality rules, license scan and url filter against brute force."""

import collections
import math
import random
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslode.llm import licenses, quality, sharding, url_rules
from corpuslode.llm.queries import op1_sharding, op6_licenses, op7_sql


def test_rendezvous_picks_the_highest_score(spark):
    ids = [(i,) for i in range(3000)] + [(7,)] * 5
    weights = {0: 1.0, 1: 1.0, 2: 2.0}
    got = {r["id"]: r for r in sharding.assign_shards(
        sharding.assign_shards(spark.createDataFrame(ids, "id long"), ["id"], weights), ["id"], weights | {3: 1.0}, "grown").collect()}

    def score(i, s, w):
        h = xxhash.xxh64_intdigest(struct.pack("<q", s), seed=xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42))
        return -w / math.log(((h >> 11) + 0.5) / 2**53)

    for i, row in got.items():
        assert row["shard"] == max(weights, key=lambda s: score(i, s, weights[s]))
        assert row["grown"] in (row["shard"], 3)
    held = collections.Counter(r["shard"] for r in got.values())
    assert 1300 < held[2] < 1700 and 600 < held[0] < 900


def test_shards_of_nulls_and_empty_tables(spark, documents, odd):
    docs = documents(odd, [None, None, 3, 3, 4, 5, 6, 7])
    assert len({r["shard"] for r in sharding.assign_shards(docs, ["doc_id"], {0: 1.0, 5: 1.0}).where("doc_id is null").collect()}) == 1
    assert sharding.slot_rows(sharding.assign_shards(docs.limit(0), ["doc_id"], {0: 1.0})).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(["doc_id"], {})


def test_slots_have_no_gaps_even_in_a_hot_shard(spark, documents, tmp_path):
    docs = documents(["a", None, "é"] * 300, [1] * 600 + list(range(300)))
    docs.drop("n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    found = collections.defaultdict(list)
    rows = op1_sharding(spark, str(tmp_path)).collect()
    for r in rows:
        found[r["shard"]].append(r["slot"])
        assert r["size"] in (2, 1, 3) and r["text_crc32"] in (zlib.crc32(b"a"), 0, zlib.crc32("é".encode()))
    assert len(rows) == 900 and all(sorted(s) == list(range(len(s))) for s in found.values())


def facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_base_counts(spark, documents, odd):
    texts = odd + ["a b c d e f g h " * 3 + "tail # | $", "w " * 30, " ".join(map(str, range(500))) + " " + " ".join(map(str, range(20)))]
    got = quality.quality_rules(documents(texts))
    assert "quality" in got.columns and got.count() == len(texts)
    for r in got.collect():
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == facts(r["text"])
        assert not (q["base_failed"] and q["kept"])
    assert quality.quality_rules(documents([])).count() == 0


def test_divergence_rejects_the_odd_one_out(documents):
    prose = [f"the cat of number {i} and the dog were in a house that is on the hill for a while and it was {i} as with all " * 6 for i in range(40)]
    junk = "| ### %%% $$$ &&& ||| *** <<< >>> " * 20
    junk = " ".join(f"{w}{i}" for i, w in enumerate(junk.split()))
    got = {r["doc_id"]: r["quality"] for r in quality.quality_rules(documents(prose + [junk, "| # % " * 8]).withColumn("lang", F.lit("en"))).collect()}
    limit = quality.QualityLimits()
    assert got[40]["class_distance"] > limit.class_distance and not got[40]["kept"]
    assert got[41]["class_distance"] is None  # below the guard
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(x * math.log2(x / y) for d in (p, q) for x, y in zip(d, m) if x) / 2)
    df = documents(["x"]).select(quality.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"))
    assert abs(df.first()["d"] - want) < 1e-12


def test_rare_languages_are_judged_by_themselves(documents, monkeypatch):
    big = [f"the cat of number {i} and the dog were in a house that is on the hill for a while and it was {i} as with all " * 6 for i in range(60)]
    rare = [f"кошка номер {i} сидела дома целый день пока шёл дождь за окном старого дома у реки {i} там " * 6 for i in range(12)]
    few = [f"γάτα νούμερο {i} ήταν στο σπίτι όλη την ημέρα όσο έβρεχε έξω από το παλιό σπίτι δίπλα στο ποτάμι {i} εκεί " * 6 for i in range(3)]

    def made(n):
        texts = [*big * n, *rare, *few]
        lang = F.when(F.col("doc_id") < len(big) * n, "en").when(F.col("doc_id") < len(big) * n + len(rare), F.lit(None)).otherwise("el")
        got = {r["doc_id"] - len(big) * n: r["quality"] for r in quality.quality_rules(documents(texts).withColumn("lang", lang)).collect()}
        return [got[i] for i in range(len(rare) + len(few))]

    def near(found):
        return [(round(q["class_distance"], 9), round(q["word_distance"], 9)) for q in found[:len(rare)]]

    limits = quality.QualityLimits()
    for n in (1, 250):  # 250: the rare languages are under a thousandth of the rows
        found = made(n)
        assert all(q["class_distance"] is not None and q["class_distance"] < limits.class_distance and q["word_distance"] < limits.word_distance for q in found[:len(rare)])
        assert all(q["class_distance"] is None and q["word_distance"] is None for q in found[len(rare):])
    want = near(found)
    monkeypatch.setattr(quality, "BROADCAST_REFERENCES", 2)
    assert near(made(1)) == want


def brute_licenses(text):
    body = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", body)
    base = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    best = {}
    for line in body.split("\n"):
        block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, template in licenses.TEMPLATES:
            want = set(re.findall(r"[a-z0-9]+", template.lower()))
            share = len(want & block) / len(want)
            if share >= 0.9:
                best[label] = max(share, best.get(label, 0))
    starts = [i for i, _ in base]
    return {"n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted({x for _, x in base} | set(best))),
            "score": 1.0 if base else max(best.values(), default=0.0)}


def test_license_scan(spark, documents, odd, rows, tmp_path):
    texts = odd + ["Released under the MIT\nLicense. mit license MIT-License", "foo\nLicensed under CC BY-NC 4.0.\nbar", "a general public license é license",
                   "Unless required by applicable law or agreed to in writing, software is distributed on an AS IS BASIS under the License",
                   licenses.TEMPLATES[11][1] + " and more", "licensed under the apache version 2.0", "words " * 400 + "apache license"]
    docs = documents(texts + texts[8:10], [None] + list(range(1, len(texts))) + [8, 9])
    got = rows(licenses.scan_licenses(docs).drop("blocks"))
    want = sorted(({"doc_id": r["doc_id"], **brute_licenses(r["text"])} for r in docs.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, repr(r)))
    assert got == want
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert op6_licenses(spark, str(tmp_path)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""
APACHE = """ * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."""


def brute_shares(text):
    """Greatest share of each label over lines, paragraphs and all runs of tokens."""
    lines = [re.findall(r"[0-9a-z]+", line) for line in text.lower().split("\n")]
    words = [w for line in lines for w in line]
    paragraphs = [[]]
    for line in lines:
        paragraphs = [*paragraphs[:-1], paragraphs[-1] + line] if line else [*paragraphs, []]
    best = {}
    for label, template in licenses.TEMPLATES:
        own = re.findall(r"[a-z0-9]+", template.lower())
        width = math.ceil(len(own) / 0.9)
        for block in [*lines, *paragraphs, *(words[i:i + width] for i in range(len(words)))]:
            share = len(set(own) & set(block)) / len(set(own))
            if share >= 0.9:
                best[label] = max(share, best.get(label, 0))
    return best


def test_wrapped_licenses(documents):
    rest = "one line before\n\n"
    broken = MIT.replace("to any person", "to\n\n any person")
    texts = [rest + MIT, BSD, rest + APACHE + "\nand more", broken, "granted hereby is\npermission", MIT + "\n\n" + APACHE, MIT.replace("\n", " ")]
    pick = random.Random(4)
    own = re.findall(r"[a-z0-9]+", licenses.TEMPLATES[1][1].lower())
    for _ in range(200):
        words = [w for w in own * 2 if pick.random() < 0.95]
        for _ in range(pick.randrange(6)):
            words.insert(pick.randrange(len(words)), "other")
        texts.append("".join(w + pick.choice([" ", " ", " ", "\n", "\n\n"]) for w in words[pick.randrange(12):len(words) - pick.randrange(14)]))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(texts)).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["mit", "bsd", "apache", "mit", "", "apache,mit", "mit"]
    assert [(b["line"], b["label"]) for b in got[0]["blocks"]] == [(2, "mit")]
    for i, text in enumerate(texts):
        want = brute_shares(text)
        assert got[i]["labels"] == ",".join(sorted(want)) and abs(got[i]["score"] - max(want.values(), default=0.0)) < 1e-12


def test_prefix_index_loses_no_template():
    index = licenses.TemplateIndex([("x", "a b c d e f g h i j")], {b"a": 5, b"j": 1}, 0.7)
    letters = [bytes([c]) for c in b"abcdefghij"]
    for mask in range(1024):
        block = [t for i, t in enumerate(letters) if mask >> i & 1] + [b"zz"]
        assert bool(list(index.matches(block))) == (bin(mask).count("1") >= 7)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en", "https://b.net/", "https://b.net", "http://x.org/fr/1",
        "http://x.org/de/1", "http://a.example.com/de/q", "http://example.com?x=://y/de/", "http://my.casino-win.example.com/a", "http://mycasino.com/",
        "http://free.bets.io/x", "http://u@h.com:80/casino", "a://b://c/fr/", "http://example.com/de/casino", "http://Ünicode.org/fr/ä"]


def test_url_verdicts_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    data = list(enumerate(URLS)) + [(100, URLS[4])] * 3
    con.executemany("INSERT INTO pages VALUES (?, ?)", data)
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in data], "page_id long, url string, host string, html string, rule string")
    judged = url_rules.judge_urls(pages, url_rules.BASE_RULES + url_rules.PATTERN_RULES)
    names = {r.name for r in url_rules.BASE_RULES}
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] if r["rule"] in names else None, r["verdict"]) for r in judged.collect())
    assert got == sorted(con.execute(op7_sql()).fetchall())
    assert judged.columns == ["page_id", "url", "host", "html", "path", "rule", "verdict"]
    assert url_rules.judge_urls(pages.limit(0), url_rules.BASE_RULES).count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    targets = spark.createDataFrame([("a.com/x",), ("b.com/x",), ("c.com/y",)], "target string")
    rules = [url_rules.UrlRule("r", "block", "y", ("com", "y")), url_rules.UrlRule("s", "block", "x", ()), url_rules.UrlRule("t", "block", "q", ("com", "q"))]
    got = {r["rule"]: r["token"] for r in url_rules.rule_index(targets, rules).collect()}
    assert got == {"r": "y", "s": "", "t": "q"}
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert url_rules.judge_urls(pages, rules).first()["rule"] == "s"
