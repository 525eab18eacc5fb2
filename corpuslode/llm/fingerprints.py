"""Homomorphic multiset hash of documents.

A document is the multiset of its paragraphs (lines that hold a word).  Its
fingerprint has two wide vectors, both sums, so that a paragraph is added or
taken away without the rest of the text:

* ``equal``: ``EQUAL_LANES`` lanes modulo 2^32, each the sum of a paragraph hash.
  Equal multisets give equal lanes in any order of paragraphs.
* ``near``: 63 lanes modulo 2^20.  Lane j counts the sentences of the paragraphs
  whose hash has bit j, three lanes in one long with a guard bit each.  With the
  number of sentences the lanes give a signed sketch, whose cosine estimates how
  much two documents share.

Null and empty texts have the zero vector.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import bind, cut, ordered_numbers, whole

EQUAL_LANES = 16
NEAR_LONGS = 21
_FIELDS = 1 | 1 << 21 | 1 << 42
_MOD20 = ((1 << 20) - 1) * _FIELDS
_MOD32 = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def sentences(parts: Column) -> Column:
    """The paragraphs cut after a full stop, question or exclamation mark and white space."""
    return F.flatten(F.transform(parts, lambda p: F.split(p, r"(?<=[.!?])\s+")))


def multiset_hash(text: Column) -> Column:
    """The fingerprint as a struct ``(equal array<bigint>, n bigint, near array<bigint>)``."""
    def total(values: Column, lane: Callable[[Column], Column], mask: int) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: (a + lane(v)).bitwiseAND(mask))

    def equal_lane(j: int) -> Callable[[Column], Column]:
        return lambda h: F.xxhash64(h, F.lit(j)).bitwiseAND(_MOD32)

    def near_lanes(k: int) -> Callable[[Column], Column]:
        return lambda h: F.shiftrightunsigned(h, k).bitwiseAND(_FIELDS)

    def of(parts: Column) -> Column:
        return bind(F.transform(parts, lambda p: F.xxhash64(p)), lambda hs: F.array(*[total(hs, equal_lane(j), _MOD32) for j in range(EQUAL_LANES)]))

    def sketch(hashes: Column) -> Column:
        return F.array(*[total(hashes, near_lanes(k), _MOD20) for k in range(NEAR_LONGS)])

    def build(parts: Column) -> Column:
        hashes = F.transform(sentences(parts), lambda s: F.xxhash64(s))
        return bind(hashes, lambda hs: F.struct(
            of(parts).alias("equal"), (F.size(hs).cast("long") % (1 << 20)).alias("n"), sketch(hs).alias("near")))

    return bind(paragraphs(text), build)


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets, or with ``sign=-1`` of what is left after taking the right one away."""
    def lanes(name: str, modulus: int, fields: int) -> Column:
        guard = (modulus + 1) * fields if sign < 0 else 0  # borrow per field, masked away again
        return F.zip_with(left[name], right[name], lambda a, b: (a + F.lit(guard) + sign * b).bitwiseAND(modulus * fields))

    return F.struct(lanes("equal", _MOD32, 1).alias("equal"), ((left["n"] + sign * right["n"] + (1 << 20)) % (1 << 20)).alias("n"),
                    lanes("near", (1 << 20) - 1, _FIELDS).alias("near"))


def fingerprint_text(value: Column) -> Column:
    """The fingerprint in hexadecimal digits, of one length for all documents."""
    def digits(lanes: Column, width: int) -> Column:
        return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")

    return F.concat(digits(value["equal"], 8), F.lit("-"), F.lpad(F.lower(F.hex(value["n"])), 5, "0"), F.lit("-"), digits(value["near"], 16))


def likeness(left: Column, right: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the signed sketches, at least 0; 0 if only one is empty."""
    def signed(value: Column) -> Column:
        """Lane sums of +1 and -1."""
        lane = lambda shift: F.transform(
            value["near"], lambda x: (2 * F.shiftrightunsigned(x, shift).bitwiseAND((1 << 20) - 1) - value["n"]).cast("double"))
        return F.concat(lane(0), lane(21), lane(42))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def cosine(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        dot = total(F.zip_with(a, b, lambda x, y: x * y))
        norm = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
        return F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / norm))).otherwise(F.lit(0.0))

    pair = F.struct(signed(left).alias("a"), signed(right).alias("b"))
    return F.when(left == right, F.lit(1.0)).otherwise(bind(pair, cosine))


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like they are.

    The edited text has the last quarter of its code points (rounded down)
    replaced by as many from the start of the next document, or all of it.  Next
    is the next greater doc_id, after the greatest the least; of rows with that
    id the text with the least hash is taken.  Rows with a null id have no next
    document: nothing replaces their last quarter, and ``near_next`` is 0 unless
    the text is empty.  Null texts are empty.  Rows that repeat get equal
    answers, other columns are not read.

    Neighbours are found among narrow ``(doc_id, length)`` rows; each text then
    crosses the network once, the part it lends a second time.
    """
    # A renamed key would make two plans of what both joins read, and the texts would be dealt out twice.
    same = doc_id == "doc_id" and docs.schema[doc_id].dataType == LongType()
    key = F.col(doc_id) if same else F.col(doc_id).cast("long").alias("doc_id")
    plain = docs.select(key, whole(text).alias("text"))
    base = plain.where("doc_id is not null").repartition("doc_id")  # dealt out once, read by both joins
    narrow = (plain.where("doc_id is not null").select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
              .groupBy("doc_id").agg(F.max("n").alias("n"), F.min("h").alias("h")))
    ranked = cut(ordered_numbers(narrow, "doc_id", "rank"))
    total = ranked.count()
    after = ranked.select(F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"), F.col("doc_id").alias("next"), F.col("h").alias("next_hash"))
    lends = ranked.join(after, "rank").select(F.col("next").alias("doc_id"), F.col("next_hash").alias("h"), F.col("doc_id").alias("taker"), F.expr("n div 4").alias("most"))
    lent = (base.join(lends, "doc_id").where(F.xxhash64("text").bitwiseXOR(F.col("h")) == 0)  # no join key: both joins go by doc_id
            .select(F.col("taker").alias("doc_id"), F.struct(F.substr(F.col("text"), F.lit(1), F.col("most").cast("int")).alias("start"), multiset_hash(F.col("text")).alias("next")).alias("lent"))
            .groupBy("doc_id").agg(F.first("lent").alias("lent")))
    alone = plain.where("doc_id is null").select("doc_id", "text", F.lit("").alias("start"), multiset_hash(F.lit("")).alias("next"))
    met = base.join(lent, "doc_id", "left").select("doc_id", "text", F.coalesce("lent.start", F.lit("")).alias("start"), F.col("lent.next").alias("next")).unionByName(alone)
    n = F.length("text")
    cut_at = (n - F.expr("length(text) div 4")).cast("int")
    quarter = F.expr("length(text) div 4").cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), cut_at), F.substr(F.col("start"), F.lit(1), quarter))
    facts = met.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), multiset_hash(F.col("text")).alias("own"), "next")
    hashed = facts.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next", multiset_hash(F.col("edited")).alias("new"))
    return hashed.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("new")).alias("edited_fingerprint"),
                         likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
