"""Toxicity by two class-conditional Kneser-Ney bigram models.

One model is learned from toxic documents, one from ordinary ones.  Counts are
document counts: an expression counts once per document, so repeated lines weigh
no more than others.  Each class discounts its bigrams and gives the freed mass to
its unigrams, which in turn back off to continuation counts that the classes
share.  Expressions that are rare, or spread over the classes as chance would have
it, stay in the shared counts alone, where both classes agree.  A bigram is judged
by its own counts, also where its words are neutral by themselves.  A text is scored in windows over its whole length: the
highest length-normalised difference of the two log-likelihoods, put through a
logistic curve that the training documents fix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, extended, release

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")  # on lower-case bytes: letters, digits and all that is not ASCII
START = b"<"  # no token
# Documents that hold a word, or a bigram, for classes to differ in it, and the test value: one in ten thousand by chance.
MIN_WORD = 4
MIN_BIGRAM = 16
CRITICAL = 15.14
DISCOUNT = 0.75
WINDOW = 32


def _tokens(text: bytes | None) -> list[bytes]:
    return _TOKEN.findall((text or b"").lower())


@dataclass(frozen=True)
class ToxicityModel:
    """Log ratios toxic to ordinary, of words and of bigrams (sorted keys), and the logistic curve."""

    words: dict[bytes, int]
    word_ratio: np.ndarray
    bigram_keys: np.ndarray
    bigram_ratio: np.ndarray
    intercept: float
    slope: float

    def evidence(self, text: bytes | None) -> float:
        """The greatest mean log ratio of a window; half windows overlap, a short text counts as half a window."""
        found = _tokens(text)
        if not found or not self.words:
            return 0.0
        ids = np.fromiter((self.words.get(w, -1) for w in found), np.int64, len(found))
        ratio = np.where(ids >= 0, self.word_ratio[ids], 0.0)
        before = ids[:-1]
        if len(self.bigram_keys) and len(ids) > 1:
            keys = np.where((before >= 0) & (ids[1:] >= 0), before * len(self.words) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.bigram_keys, keys), len(self.bigram_keys) - 1)
            ratio[1:] = np.where(self.bigram_keys[at] == keys, self.bigram_ratio[at], ratio[1:])
        total = np.concatenate(([0.0], np.cumsum(ratio)))
        half = WINDOW // 2
        starts = np.arange(0, max(len(ratio) - half, 1), half)
        ends = np.minimum(starts + WINDOW, len(ratio))
        return float(((total[ends] - total[starts]) / np.maximum(ends - starts, half)).max())

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.evidence(text), -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, most: int, text: str, doc_id: str) -> DataFrame:
    """``(text, toxic)`` of labelled documents: all, or about ``most`` chosen by a hash of the id.

    ``allowed`` is a condition on ``labels``.  A document with several labels is
    toxic if one of them says so.
    """
    known = (labels.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("_key")).agg(F.max("toxic").cast("int").alias("toxic")))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    # About ``most`` rows of twelve bytes.
    return docs.select(F.col(doc_id).cast("long").alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key").select("text", "toxic")


def bigram_table(rows: DataFrame, chunk: int = 200) -> DataFrame:
    """``(first, second, toxic, ordinary)``: documents of each class that hold a bigram; the first word follows ``START``."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                counts: dict[tuple[bytes, bytes], list[int]] = {}
                for value, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = _tokens(value)
                    for pair in set(zip([START, *words], words)):
                        counts.setdefault(pair, [0, 0])[0 if toxic else 1] += 1
                columns = [[p[0] for p in counts], [p[1] for p in counts], [n[0] for n in counts.values()], [n[1] for n in counts.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))],
                                                 names=["first", "second", "toxic", "ordinary"])

    counted = rows.select(F.col("text").cast("binary"), "toxic").mapInArrow(pairs, "first binary, second binary, toxic long, ordinary long")
    return counted.groupBy("first", "second").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def decided(least: int, prior: Column) -> Column:
    """Whether the classes differ in an expression: held by ``least`` documents, and a likelihood-ratio test against ``prior`` says so."""
    toxic, ordinary = F.col("toxic"), F.col("ordinary")
    total = toxic + ordinary

    def term(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.ln(n / expected)).otherwise(F.lit(0.0))

    g = 2 * (term(toxic, total * prior) + term(ordinary, total * (1 - prior)))
    return (total >= least) & (g >= CRITICAL)


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 20_000, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """Learn both models and the logistic curve from ``allowed`` labels.

    ``most`` bounds the labelled documents used; it is the only bound.  Without
    documents of both classes every text scores 0.
    """
    rows = training_rows(docs, labels, allowed, most, text, doc_id)
    neutral = ToxicityModel({}, np.zeros(1), np.zeros(0, np.int64), np.zeros(0), -30.0, 0.0)
    table = cut(bigram_table(rows))
    total = table.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("pairs")).first()
    if not total["toxic"] or not total["ordinary"]:
        return neutral
    all_contexts = total["pairs"]
    prior = F.lit(total["toxic"] / (total["toxic"] + total["ordinary"]))
    counted = (table.groupBy("second").agg(F.count("*").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    words = counted.where(decided(MIN_WORD, prior)).toPandas().sort_values("second", ignore_index=True)
    after = table.groupBy("first").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    frequent = table.where((F.col("first") != F.lit(START)) & decided(MIN_BIGRAM, prior))
    firsts = after.join(frequent.select("first").distinct(), "first").toPandas().set_index("first")
    pairs = frequent.toPandas()
    # Words of such bigrams, as first or second, that are neutral by themselves: the classes share their estimate.
    members = frequent.select(F.explode(F.array("first", "second")).alias("second")).distinct()
    neutral_words = counted.join(members, "second").where(~decided(MIN_WORD, prior)).toPandas().sort_values("second", ignore_index=True)
    if not len(words) and not len(neutral_words):
        return neutral
    shared = words["contexts"].to_numpy(float) / all_contexts
    alike = neutral_words["contexts"].to_numpy(float) / all_contexts
    unigram = {kind: np.concatenate([_discounted(words[kind].to_numpy(float), total[kind], shared), alike]) for kind in ("toxic", "ordinary")}
    index = {w: i for i, w in enumerate([*words["second"], *neutral_words["second"]])}
    keys, ratios = [], []
    for first, group in pairs.groupby("first", sort=False):
        second = np.array([index[w] for w in group["second"]], np.int64)
        given = {kind: _discounted(group[kind].to_numpy(float), max(float(firsts.at[first, kind]), 1.0), unigram[kind][second]) for kind in unigram}
        keys.append(index[first] * len(index) + second)
        ratios.append(np.log(given["toxic"] / given["ordinary"]))
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    ratios = np.concatenate(ratios) if ratios else np.zeros(0)
    order = np.argsort(keys)
    model = ToxicityModel(index, np.log(unigram["toxic"] / unigram["ordinary"]), keys[order], ratios[order], 0.0, 1.0)
    seen = rows.select(F.col("text").cast("binary").alias("text"), "toxic").mapInArrow(_evidence(model), "evidence double, toxic int").toPandas()
    intercept, slope = _logistic(seen["evidence"].to_numpy(), seen["toxic"].to_numpy(float))
    return ToxicityModel(model.words, model.word_ratio, model.bigram_keys, model.bigram_ratio, intercept, slope)


def _discounted(counts: np.ndarray, whole: float, backoff: np.ndarray) -> np.ndarray:
    """Kneser-Ney estimate: counts less the discount, and the freed mass dealt out by ``backoff``."""
    freed = (np.minimum(counts, DISCOUNT).sum() + DISCOUNT) / whole
    return np.maximum(counts - DISCOUNT, 0) / whole + freed * backoff


def _evidence(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(x) for x in batch.column(0).to_pylist()], pa.float64()), batch.column(1)],
                                             names=["evidence", "toxic"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Intercept and slope by Newton's method with damped steps; the ridge keeps separable classes finite."""
    a = b = 0.0

    def loss(a: float, b: float) -> float:
        z = a + b * x
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * b * b / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p)
        slope_a, slope_b = (p - y).sum(), ((p - y) * x).sum() + ridge * b
        aa, ab, bb = w.sum() + 1e-9, (w * x).sum(), (w * x * x).sum() + ridge
        det = aa * bb - ab * ab
        step_a, step_b = (bb * slope_a - ab * slope_b) / det, (aa * slope_b - ab * slope_a) / det
        size = 1.0
        while size > 1e-4 and loss(a - size * step_a, b - size * step_b) > loss(a, b):
            size /= 2
        a, b = a - size * step_a, b - size * step_b
        if size * max(abs(step_a), abs(step_b)) < 1e-8:
            break
    return float(a), float(b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``); columns of these names are replaced.

    Null and empty texts give no evidence and get the score of such.  Each row
    is scored by itself; rows that repeat score alike.
    """
    plain = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            scores = np.array([shared.value.score(x) for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             names=[*batch.schema.names, "score", "predicted"])

    return plain.mapInArrow(run, extended(plain.schema, "score double, predicted int"))
