"""Packing of documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenized and cut into full pieces and one remainder.  The
histogram of remainder lengths, at most one entry per length, is a cutting-stock
problem: a linear program over patterns (how many pieces of which lengths share a
sequence), whose columns are found one by one by a knapsack that prices lengths
with the program's dual values.  The program is bounded by the sequence length,
not by the corpus, so it is solved on the driver; everything per document is not.
Patterns are used a whole number of times, what rounding leaves over is filled
greedily, and the k-th piece of a length takes the k-th place of that length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import extended, kept, numbered, placed, units

# Text units whose ids a Python worker keeps.
UNITS = 900_000
# Documents whose unknown units are tokenized in one call.
CHUNK = 400

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # times used, (length, pieces) from the longest


class _UnitIds:
    """Ids of text units as little-endian unsigned 32-bit bytes; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}

    def of(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its units; units not met before go to the tokenizer together."""
        if len(self.known) >= UNITS:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        for unit, coded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[unit] = np.array(coded.ids, "<u4").tobytes()
        out = [b"".join(map(self.known.__getitem__, text)) for text in texts]
        for unit in new:
            if len(unit) > 64:
                del self.known[unit]
        return out


def _unit_ids(path: str) -> _UnitIds:
    """One in each Python worker, which has one core, until tasks of another file or operator come."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept((_UnitIds, path), lambda: _UnitIds(path))


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: each document's ids and an end id, cut every ``size`` ids.

    Null and empty texts are one piece, the end id.  Every row is tokenized by
    itself, so rows that repeat give pieces that repeat.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _unit_ids(tokenizer)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                for key, body in zip(part.column(0).to_pylist(), known.of([units(value) if value else [] for value in part.column(1).to_pylist()])):
                    ids = memoryview(body + end)
                    for start in range(0, len(ids), 4 * size):
                        piece = ids[start:start + 4 * size]
                        for column, item in zip(columns, (key, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                            column.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the dearest multiset of lengths with a sum of at most ``size``, and its price."""
    worth = np.full(size + 1, -np.inf)  # by length
    worth[lengths] = prices
    value, choice = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        offers = worth[1:room + 1] + value[room - 1::-1]
        best = int(offers.argmax())
        if offers[best] > value[room - 1] + 1e-12:
            value[room], choice[room] = offers[best], best + 1
        else:
            value[room] = value[room - 1]
    column, room = np.zeros(len(lengths)), size
    at = {int(length): i for i, length in enumerate(lengths)}
    while room > 0:
        if choice[room]:
            column[at[int(choice[room])]] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return float(value[size]), column


def fill(lengths: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """A pattern that takes the longest pieces of ``left`` that still fit, one length after the other."""
    room, column = size, np.zeros(len(lengths))
    for i in range(len(lengths) - 1, -1, -1):
        if left[i] > 0 and lengths[i] <= room:
            column[i] = min(np.ceil(left[i]), room // lengths[i])
            room -= int(column[i] * lengths[i])
    return column


def first_basis(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy patterns, each used until it has exhausted a length, and their uses.

    A pattern lacks the lengths exhausted before it, so the columns are
    independent and a feasible basis.
    """
    left, basis, amount = demand.copy(), np.zeros((len(lengths), len(lengths))), np.zeros(len(lengths))
    for k in range(len(lengths)):
        column = fill(lengths, left, size)
        used = np.flatnonzero(column)
        uses = left[used] / column[used]
        out = used[int(uses.argmin())]
        basis[:, k], amount[k] = column, uses.min()
        left[used] = np.maximum(left[used] - column[used] * amount[k], 1e-9)
        left[out] = 0
    return basis, amount


def solve_patterns(histogram: Mapping[int, int], size: int, gap: float = 0.002, pivots: int = 600) -> list[Pattern]:
    """Patterns that together hold exactly the pieces of ``histogram`` (length: pieces, none longer than ``size``).

    Revised simplex with column generation, from greedy patterns.  Columns are
    priced at duals drawn towards those of the best bound so far.  It ends within
    ``gap`` of that lower bound on the number of sequences, or after ``pivots``
    exchanges; a sooner end costs some padding and nothing else.
    """
    counts = {length: n for length, n in histogram.items() if n}
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return []
    demand = np.array([counts[int(length)] for length in lengths], float)
    basis, amount = first_basis(lengths, demand, size)
    inverse = _inverse(basis)
    centre = lengths / size  # feasible duals: no pattern is worth more than 1
    bound = float((centre * demand).sum())
    for _ in range(pivots):
        if amount.sum() <= bound * (1 + gap):
            break
        duals = inverse.sum(axis=0)
        for drawn in (0.7 * centre + 0.3 * duals, duals):
            price, column = best_pattern(lengths, drawn, size)
            if (drawn * demand).sum() / price > bound:
                bound, centre = float((drawn * demand).sum() / price), drawn / price
            if (duals * column).sum() > 1 + 1e-9:
                break
        else:
            break
        direction = (inverse * column).sum(axis=1)
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[:, out] = column
    times = np.floor(amount + 1e-6).astype(np.int64)
    times = _within(basis, times, demand)
    patterns = [(int(t), basis[:, i]) for i, t in enumerate(times) if t]
    left = (demand - (basis * times).sum(axis=1)).round().astype(np.int64)
    while left.any():
        column = fill(lengths, left, size)
        used = column > 0
        patterns.append((int((left[used] // column[used]).min()), column))
        left -= (column * patterns[-1][0]).astype(np.int64)
    return [(t, tuple((int(lengths[i]), int(c[i])) for i in range(len(lengths) - 1, -1, -1) if c[i])) for t, c in patterns]


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Inverse of the greedy basis by substitution.

    Sorted by where they are exhausted, its rows form a triangle.  Plain array
    arithmetic, since threaded linear algebra may stall beside a busy JVM.
    """
    m = len(basis)
    last = np.array([np.flatnonzero(row)[-1] for row in basis])  # the pattern that exhausts a length is its last
    rows = np.empty(m, np.int64)
    rows[last] = np.arange(m)
    inverse = np.zeros((m, m))
    for k in range(m):
        known = (basis[rows[k], :k, None] * inverse[:k]).sum(axis=0) if k else np.zeros(m)
        inverse[k] = -known
        inverse[k, rows[k]] += 1
        inverse[k] /= basis[rows[k], k]
    return inverse


def _within(basis: np.ndarray, times: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Take back uses that rounding errors put above the demand."""
    while ((over := (basis * times).sum(axis=1) - demand) > 0.5).any():
        length = int(over.argmax())
        times[int(np.where(basis[length] > 0, times, -1).argmax())] -= 1
    return times


def places(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per place of a pattern, by length and first piece number: length, first piece, first sequence, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, parts in patterns:
        offset = 0
        for length, pieces in parts:
            for _ in range(pieces):
                rows.append((length, taken.get(length, 0), sequence, offset))
                taken[length] = taken.get(length, 0) + times
                offset += length
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack_pieces(pieces: DataFrame, size: int, gap: float = 0.002) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``size``.

    Sequences are numbered from 0 without gaps, each is filled from its start
    without gaps, and none exceeds ``size``.  Pieces of one length are
    interchangeable: ties and repeated rows take any of its places.  An empty
    table stays empty, other columns stay.
    """
    rows = placed(pieces.drop("sequence_id", "offset"))
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``size`` rows
    length, first, sequence, offset = places(solve_patterns(histogram, size, gap))
    longest = max(histogram.values(), default=0) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = length * longest + first
        for batch in batches:
            own, rank = (batch.column(batch.schema.get_field_index(name)).to_numpy() for name in ("length", "_rank"))
            at = np.searchsorted(starts, own * longest + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                                             names=[*batch.schema.names, "sequence_id", "offset"])

    ranked = numbered(rows, ["length"], "_rank")
    return ranked.mapInArrow(place, extended(ranked.schema, "sequence_id long, offset long")).drop("_rank")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """All documents as pieces with their sequence and offset; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(token_pieces(docs, tokenizer, end_id, size), size)
