"""Log-likelihood of whole documents under a unigram base and a gated recurrent model.

Word counts of all training documents are gathered by one aggregation.  The most
frequent words are symbols of the recurrent model (``gru.py``); every other word
belongs to a class by its last two bytes, the model gives the class and the counts
give the word within it.  Every training document is run through once: tasks
train copies of the model on their own documents, and parameters are averaged
between rounds by symbol count.  Scoring needs a word's count: those of the
``KNOWN`` most frequent words travel with the model, the others meet the count
table in a join whose result is summed per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Memo, cut
from .gru import Gru, Shape, Trainer, first_parameters

END = b""  # no word is empty
FREQUENT = 2000
OTHERS = 24
KNOWN = 100_000
# Words whose codes, and distinct words whose counts, a Python worker keeps.
CODES = 800_000
COUNTED = 200_000
# The first round trains on one in ``FIRST_PART`` documents, the second on the rest.
FIRST_PART = 4


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end."""
    return [*(text or b"").lower().split(), END]


def other_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % OTHERS


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts, each followed by an end."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        get = total.get

        def emptied() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for value in batch.column(0).to_pylist():
                for word in words_of(value):
                    total[word] = get(word, 0) + 1
                if len(total) >= COUNTED:
                    yield emptied()
        yield emptied()

    return docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the known words, the most frequent first, and of everything."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    other_tokens: np.ndarray
    other_distinct: np.ndarray
    frequent: int

    @property
    def shape(self) -> Shape:
        return Shape(self.frequent, OTHERS)

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def coder(self) -> Memo:
        """Word to its place among the known, or -1 less its class."""
        known = {w: i for i, w in enumerate(self.words)}
        return Memo(lambda word: known[word] if word in known else -1 - other_class(word), CODES)

    def symbols(self) -> np.ndarray:
        """Model symbol by code; codes below zero count from the end."""
        own = np.arange(len(self.words))
        classes = np.array([other_class(w) for w in self.words], np.int64)
        return np.concatenate([np.where(own < self.frequent, own, self.frequent + classes), self.frequent + np.arange(OTHERS - 1, -1, -1)]).astype(np.int32)


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """The end is always the first known word; then by count, words of equal count in byte order."""
    ranked = counts.withColumn("_end", F.col("word") == F.lit(END)).orderBy(F.desc("_end"), F.desc("n"), "word").limit(KNOWN).select("word", "n").toPandas()
    group = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(OTHERS)).alias("class")
    sums = counts.groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, distinct = np.zeros(OTHERS), np.zeros(OTHERS)
    for row in sums:
        tokens[row["class"]], distinct[row["class"]] = row["n"], row["v"]
    total, types = int(tokens.sum()), int(distinct.sum())
    words, n = [bytes(w) for w in ranked["word"]], ranked["n"].to_numpy(float)
    for word, count in zip(words[:FREQUENT], n):
        tokens[other_class(word)] -= count
        distinct[other_class(word)] -= 1
    return Vocabulary(words, n, total, types, tokens, distinct, min(FREQUENT, len(words)))


def train(docs: DataFrame, vocabulary: Vocabulary, start: np.ndarray, text: str = "text") -> np.ndarray:
    """One pass of truncated backpropagation over ``docs`` in every task, then the average of the tasks' parameters."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, start))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vector = shared.value
        code, symbols = own.coder(), own.symbols()
        trainer = Trainer(vector, own.shape)
        for batch in batches:
            documents = []
            for value in batch.column(0).to_pylist():
                words = words_of(value)
                documents.append(symbols[np.fromiter(map(code.__getitem__, words), np.int64, len(words))])
            trainer.learn(documents)
        if trainer.symbols:
            weight = float(trainer.symbols)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vector), dtype=np.int32)), pa.array(trainer.model.vector.astype(float) * weight), pa.array(np.full(len(vector), weight))],
                                             names=["slot", "value", "weight"])

    learned = docs.select(F.col(text).cast("binary")).mapInArrow(learn, "slot int, value double, weight double")
    mean = learned.groupBy("slot").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
    out = np.array(start, np.float32)
    out[mean["slot"].to_numpy(np.int64)] = mean["value"].to_numpy(np.float32)
    return out


def fit_model(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """Parameters after both rounds; together they cover every document of ``docs``."""
    counts = np.concatenate([vocabulary.counts[:vocabulary.frequent], vocabulary.other_tokens])
    vector = first_parameters(vocabulary.shape, counts)
    first = F.pmod(F.xxhash64(doc_id), F.lit(FIRST_PART)) == 0
    vector = train(docs.where(first), vocabulary, vector, text)
    return train(docs.where(~first), vocabulary, vector, text)


def score_documents(docs: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row, learned where ``training`` holds.

    Null and empty texts are an end alone.  Without any training row all counts
    are zero and the model is its first parameters.  Rows that repeat are counted
    and learned each time and get equal scores.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), training.alias("_train"))
    learned = plain.where("_train")
    counts = cut(count_words(learned))
    vocabulary = read_vocabulary(counts)
    vector = fit_model(learned, vocabulary) if vocabulary.words else first_parameters(vocabulary.shape, vocabulary.other_tokens)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vector))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parameters = shared.value
        code, symbols, model = own.coder(), own.symbols(), Gru(parameters, own.shape)
        unseen = np.zeros(OTHERS)
        base_of = np.concatenate([own.base_log(own.counts), unseen])
        classes = symbols[own.frequent:len(own.words)] - own.frequent
        word_of = np.concatenate([np.zeros(own.frequent), np.log10((own.counts[own.frequent:] + 0.1) / (own.other_tokens[classes] + 0.1 * (own.other_distinct[classes] + 1))), unseen])
        for batch in batches:
            documents, sizes, known, base, words_part, rare = [], [], [], [], [], []
            for value in batch.column(1).to_pylist():
                words = words_of(value)
                codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
                documents.append(symbols[codes])
                sizes.append(len(words))
                known.append(int((codes >= 0).sum()))
                base.append(float(base_of[codes].sum()))
                words_part.append(float(word_of[codes].sum()))
                others: dict[bytes, int] = {}
                for i in np.flatnonzero(codes < 0):
                    others[words[i]] = others.get(words[i], 0) + 1
                rare.append(list(others.items()))
            model_part = model.log10_of(documents) + np.array(words_part)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model_part, pa.float64()),
                pa.array(rare, pa.map_(pa.binary(), pa.int64()))], names=["doc_id", "_train", "n_tokens", "known", "base", "model", "rare"])

    scored = cut(plain.select("doc_id", F.col("text").cast("binary").alias("text"), "_train").mapInArrow(
        score, "doc_id long, _train boolean, n_tokens long, known long, base double, model double, rare map<binary,bigint>")
        .withColumn("_row", F.monotonically_increasing_id()))
    n = F.coalesce(F.col("n"), F.lit(0))
    group = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(OTHERS)).cast("int")
    mass = F.array(*[F.lit(float(t + 0.1 * (v + 1))) for t, v in zip(vocabulary.other_tokens, vocabulary.other_distinct)])
    met = scored.select("_row", F.explode("rare").alias("word", "times")).join(counts, "word", "left").select(
        "_row", (F.col("times") * F.log10((n + 0.1) / F.lit(vocabulary.tokens + 0.1 * (vocabulary.distinct + 1)))).alias("base"),
        (F.col("times") * F.log10((n + 0.1) / mass[group])).alias("model"), F.when(n > 0, F.col("times")).otherwise(0).alias("known"))
    late = met.groupBy("_row").agg(F.sum("base").alias("_base"), F.sum("model").alias("_model"), F.sum("known").alias("_known"))
    zero = F.lit(0.0)
    return scored.drop("rare").join(late, "_row", "left").select(
        "doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("_model", zero)).alias("score"))
