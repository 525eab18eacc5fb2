"""Quality rules: base counts of a text, and its divergence from a language reference.

A document has two histograms: its characters by class, and its common words
(a fixed list of function words, the rest in one bin).  References are the mean
histograms of each language over the whole corpus.  A document is rejected when
the Jensen-Shannon distance of a histogram to its language's reference is beyond
a limit; texts shorter than a guard are not judged by a histogram.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind, cut, whole, words_of

# Function words of the languages at hand; references say how frequent each is in which language.
COMMON_WORDS = tuple(sorted(set(
    "the of and to in a is that it for on was as with be by are this at from or an not".split()
    + "der die und das den von zu mit sich des auf für ist im dem nicht ein eine".split()
    + "de la le et les des en un une du que est pour qui dans par sur pas avec".split()
    + "el los y se del las con su para como es al lo una por más".split())))
# Character classes, in the order in which they are taken out of a text; what is left is the last class.
CLASSES = ("[a-z]+", r"[\x20\x09-\x0D]+", "[A-Z]+", "[0-9]+", r"[#*$%&|<>]+", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
# Most references that are broadcast; more of them meet the texts in a shuffle, each under this many salts.
BROADCAST_REFERENCES = 1000
SALTS = 64
# Fewest texts whose mean is a reference; with fewer in a language, that histogram does not count.
REFERENCE_TEXTS = 10


@dataclass(frozen=True)
class QualityLimits:
    """Greatest distances, and the least size of a text for each histogram to count."""

    class_distance: float = 0.25
    word_distance: float = 0.315
    class_chars: int = 120
    word_count: int = 80


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words in windows of ``width`` words that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash.  Only texts with a repeated window
    pay for finding its places.
    """
    def covered(hashes: Column) -> Column:
        def places(ordered: Column) -> Column:
            def met(k: Column, hash_: Column) -> Column:
                return F.coalesce(F.get(ordered, k)["h"] == hash_, F.lit(False))

            same = F.filter(ordered, lambda w, k: met(k - 1, w["h"]) | met(k + 1, w["h"]))
            return F.array_sort(F.transform(same, lambda w: w["i"]))

        starts = bind(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct((i + width).alias("end"), (a["n"] + (i + width - F.greatest(i, a["end"]))).cast("long").alias("n")))["n"]

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    found = bind(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > width, found).otherwise(F.lit(0).cast("long"))


def _class_counts(text: Column) -> Column:
    """Characters of each class and of the rest, as an array."""
    def step(rest: Column, left: Sequence[str], counts: list[Column]) -> Column:
        if not left:
            return F.array(*counts, F.length(rest).cast("long"))
        return bind(F.regexp_replace(rest, left[0], ""), lambda less: step(less, left[1:], [*counts, (F.length(rest) - F.length(less)).cast("long")]))

    return step(text, CLASSES, [])


def _common_counts(words: Column) -> Column:
    """How often each common word occurs, and the number of other words, as an array."""
    found = F.filter(F.transform(words, F.lower), lambda w: w.isin(*COMMON_WORDS))

    def count(line: Column) -> Column:
        each = [((F.length(line) - F.length(F.replace(line, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON_WORDS]
        return F.array(*each)

    counts = bind(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")), count)
    return bind(counts, lambda c: F.concat(c, F.array(F.size(words).cast("long") - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``_facts``: words, characters, repetition and both histograms of each whole text."""
    body = whole(text)

    def facts(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(body).cast("long").alias("n_chars"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"), _class_counts(body).alias("classes"), _common_counts(words).alias("commons"))

    return docs.withColumn("_facts", bind(words_of(F.col(text)), facts))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return bind(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def jensen_shannon(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two histograms with sum 1: 0 if equal, 1 without a common bin, null if one is null."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(left, right, lambda x, y: part(x, y) + part(y, x))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2
    return F.when(left.isNotNull() & right.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), divergence)))


def _histograms(facts: Column, limits: QualityLimits) -> list[Column]:
    """Shares by class and by common word, null where the text is too short for them."""
    return [F.when(facts["n_chars"] >= limits.class_chars, _shares(facts["classes"])).alias("classes"),
            F.when(facts["n_words"] >= limits.word_count, _shares(facts["commons"])).alias("commons")]


def references(docs: DataFrame, limits: QualityLimits, text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """Mean histograms of every language: a table ``(_language, class_reference, word_reference)``, and its number of rows.

    A null language is one of its own, here the empty string.  A reference is
    null with fewer than ``REFERENCE_TEXTS`` texts long enough for it.
    """
    body = whole(text)
    facts = bind(words_of(F.col(text)), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(body).alias("n_chars"), _class_counts(body).alias("classes"), _common_counts(w).alias("commons")))
    shares = docs.select(_language(lang), facts.alias("f")).select("_language", *_histograms(F.col("f"), limits))
    bins = [("c", "classes", i) for i in range(len(CLASSES) + 1)] + [("w", "commons", i) for i in range(len(COMMON_WORDS) + 1)]
    sums = cut(shares.groupBy("_language").agg(
        F.count("classes").alias("nc"), F.count("commons").alias("nw"), *[F.sum(F.col(col)[i]).alias(f"{k}{i}") for k, col, i in bins]))
    names = {k: [f"{kind}{i}" for kind, _, i in bins if kind == k] for k in "cw"}
    means = [F.when(F.col(f"n{k}") >= REFERENCE_TEXTS, F.array(*[F.col(c) / F.col(f"n{k}") for c in names[k]])).alias(out)
             for k, out in (("c", "class_reference"), ("w", "word_reference"))]
    return sums.select("_language", *means), sums.count()


def _with_references(docs: DataFrame, table: DataFrame, languages: int) -> DataFrame:
    """Rows with the references of their ``_language``; a language's rows are dealt out over ``SALTS`` parts where the table is shuffled."""
    if languages <= BROADCAST_REFERENCES:
        return docs.join(F.broadcast(table), "_language", "left")
    dealt = docs.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(salted.hint("shuffle_hash"), ["_language", "_salt"], "left").drop("_salt")


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang), F.lit("")).alias("_language")


def quality_rules(docs: DataFrame, limits: QualityLimits = QualityLimits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the struct ``quality``: the base counts, ``base_failed``, both distances and ``kept``.

    A text fails the base rules with fewer than 20 words, or with more than 30 %
    of them in repeated windows; null and empty texts have no words.  A distance
    is null where the guard does not let it count, or the language has too few
    texts for a reference, and then rejects nothing.  Every row is judged by its
    own language alone, so ties and repeated rows need no rule; all columns stay,
    one named ``quality`` is replaced.  The text is read twice, for the references
    and for the verdicts.  Nothing but sums is shuffled up to
    ``BROADCAST_REFERENCES`` languages; with more, the rows are.
    """
    table, languages = references(docs, limits, text, lang)
    judged = _with_references(measured(docs.drop("quality"), text).withColumn("_language", _language(lang)), table, languages)
    fact = F.col("_facts")
    classes, commons = _histograms(fact, limits)
    base_failed = (fact["n_words"] < 20) | (100 * fact["n_repeat_words"] > 30 * fact["n_words"])
    verdict = F.struct(
        fact["n_words"].alias("n_words"), (fact["n_chars"] - fact["classes"][1]).alias("word_chars"), fact["classes"][4].alias("n_symbols"),
        fact["n_dup_lines"].alias("n_dup_lines"), fact["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"),
        jensen_shannon(classes, F.col("class_reference")).alias("class_distance"),
        jensen_shannon(commons, F.col("word_reference")).alias("word_distance"))
    kept = (~F.col("quality.base_failed") & (F.coalesce(F.col("quality.class_distance"), F.lit(0.0)) <= limits.class_distance)
            & (F.coalesce(F.col("quality.word_distance"), F.lit(0.0)) <= limits.word_distance))
    return (judged.withColumn("quality", verdict).withColumn("quality", F.col("quality").withField("kept", kept))
            .drop("_facts", "_language", "class_reference", "word_reference"))
