"""The queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (byte_bpe, fingerprints, language_model, licenses, merge_bpe, near_duplicates, packing, periodic_runs, quality, ranked_search, sharding, toxicity,
               url_rules)
from .common import bind, id_crc, whole, words_of

SHARDS = 16
SIZE = 1024


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that tasks import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_corpuslode_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="corpuslode-py-"), "corpuslode_package.zip")
    with zipfile.ZipFile(path, "w") as file:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    file.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._corpuslode_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``key``: the id and the number of shards decide."""
    docs = table(spark, folder, "documents")
    facts = docs.select("doc_id", (F.octet_length(whole("text")) + 1).cast("long").alias("size"),
                        F.crc32(whole("text").cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    weights = {shard: 1.0 for shard in range(SHARDS)}
    placed = sharding.assign_shards(facts, ["doc_id"], weights)
    grown = sharding.assign_shards(placed, ["doc_id"], weights | {SHARDS: 1.0}, "grown_shard")
    return sharding.slot_rows(grown).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents")).select(
        "doc_id", *[F.col(f"quality.{c}").alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")])


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, SIZE)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), id_crc("doc_id") % 4 != 2)
    return toxicity.score_toxicity(docs, model).select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "score", "predicted")


def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_documents(table(spark, folder, "documents"), id_crc("doc_id") % 10 != 0)


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("blocks")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, folder, "pages").select("page_id", "url"), url_rules.BASE_RULES + url_rules.PATTERN_RULES)
    names = [r.name for r in url_rules.BASE_RULES]
    return judged.select("page_id", "host", "path", F.when(F.col("rule").isin(*names), F.col("rule")).alias("rule"), "verdict")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digest_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def planted(doc_id: str, text: str) -> Column:
    """The text; where a tenth of the ids' hashes says so, its words from one place on repeat a few."""
    crc = id_crc(doc_id)
    seed = F.floor(crc / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        first = seed % n
        period = 1 + F.floor((n - first) / (3 + seed % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(words, F.when(i < first, i).otherwise(first + (i - first) % period).cast("int"))), " ")

    return F.when(crc % 10 == 0, bind(words_of(F.col(text)), lambda words: F.when(F.size(words) > 0, repeated(words)).otherwise(""))).otherwise(whole(text))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", planted("doc_id", "text").alias("text"))
    found = periodic_runs.collapse_runs(docs)
    # Of the longest runs the one that starts first; negative numbers make the largest struct the right one.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_merge_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return merge_bpe.digest_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_sql() -> str:
    """Every document against every item; a null id ranks last."""
    return r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT doc, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
sums AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tfs AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM words) GROUP BY doc, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, sums GROUP BY term, n_docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc), sums GROUP BY item_id, doc, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50"""


def op7_sql() -> str:
    """The verdicts without an index: every rule on every url."""
    own = "|".join("[^a-z0-9]".join(r.literals) for r in url_rules.PATTERN_RULES)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(lower(concat(host, path)), '(^|[^a-z0-9])({own})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_quality, op3_packing, op4_toxicity, op5_language_model, op6_licenses, op7_url_filter,
                            op8_near_duplicates, op9_fingerprints, op10_byte_bpe, op11_ranked_search, op12_periodic_runs, op13_merge_bpe)}

# The others hash, tokenize or learn in ways SQL has no words for; tests hold them against brute force.
SQL: dict[str, Callable[[], str]] = {"op7_url_filter": op7_sql, "op11_ranked_search": op11_sql}
