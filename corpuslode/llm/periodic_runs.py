"""Runs of repeated words, found by longest common extensions from a difference cover.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends.  One of at least ``k * q`` words (``k`` 3 or more)
holds grid points of every residue: the first multiple of ``q`` in it begins an
extension of more than ``(k - 2) * q`` words against the words ``q`` later.  So
every period only looks at its own multiples, a harmonic number of them in all.

How far two places of a text agree is answered by a difference cover modulo 13:
within 13 words both places meet sampled ones, which are the only suffixes
sorted, and a sparse table over their common prefixes gives the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import extended

# Words of texts that are looked at together, and pairs of places compared at once; a longer text is looked at alone.
BLOCK = 1 << 20
PAIRS = 1 << 20

# Every difference modulo 13 is one of two members of the cover.
MODULUS = 13
COVER = np.array([0, 1, 3, 9])


def _meeting() -> np.ndarray:
    """For two residues, the least shift that brings both into the cover."""
    out = np.empty((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)
    return out


MEETING = _meeting()


class Extensions:
    """Longest common extensions to the right within an array whose texts end in values found nowhere else."""

    def __init__(self, words: np.ndarray):
        size = -(-len(words) // MODULUS) * MODULUS + 2 * MODULUS
        # Behind the words stand values that agree with nothing.
        low = min(0, int(words.min(initial=0)))
        self.words = np.concatenate([words, low - 1 - np.arange(size - len(words))])
        self.rows = size // MODULUS - 1
        self.place = np.full(MODULUS, -1)
        self.place[COVER] = np.arange(len(COVER))
        at = (COVER[:, None] + MODULUS * np.arange(self.rows)[None, :]).ravel()
        names = self._first_names(at)
        levels = [names]
        step = 1
        while names.max() + 1 < len(names):  # doubling: the name of 13 * step words, then of those behind them
            follow = np.zeros((len(COVER), self.rows), np.int64)
            follow[:, :-step] = names.reshape(len(COVER), -1)[:, step:] + 1
            names = np.unique(names * (len(names) + 1) + follow.ravel(), return_inverse=True)[1]
            levels.append(names)
            step *= 2
        self.rank = names
        order = np.argsort(names)
        self.table = [self._neighbours(at, order, levels)]
        while (half := 1 << (len(self.table) - 1)) * 2 <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _first_names(self, at: np.ndarray) -> np.ndarray:
        """Names of the 13 words from each sampled place on, in their order."""
        block = np.lib.stride_tricks.sliding_window_view(self.words, MODULUS)[at]
        order = np.lexsort(block.T[::-1])
        ordered = block[order]
        fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1]).any(axis=1)])
        names = np.empty(len(at), np.int64)
        names[order] = np.cumsum(fresh)
        return names

    def _neighbours(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of sampled suffixes that stand next to each other in order."""
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(x), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][x] == levels[level][y]
            x[same] += 1 << level
            y[same] += 1 << level
            common[same] += MODULUS << level
        return common + self._compare(at[x], at[y], np.full(len(x), MODULUS))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from both places on, ``most`` at most; ``most`` is at most 13."""
        found = np.zeros(len(i), np.int64)
        alive = np.flatnonzero(most > 0)
        for t in range(MODULUS):
            alive = alive[(self.words[i[alive] + t] == self.words[j[alive] + t])]
            found[alive] += 1
            alive = alive[most[alive] > t + 1]
            if not len(alive):
                break
        return found

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on agree, for two different places each."""
        shift = MEETING[i % MODULUS, j % MODULUS]
        found = self._compare(i, j, shift)
        whole = np.flatnonzero(found == shift)
        a, b = i[whole] + shift[whole], j[whole] + shift[whole]
        ra = self.rank[self.place[a % MODULUS] * self.rows + a // MODULUS]
        rb = self.rank[self.place[b % MODULUS] * self.rows + b // MODULUS]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(float))[1] - 1
        for n in np.unique(level):
            mine = level == n
            least = np.minimum(self.table[n][low[mine]], self.table[n][high[mine] - (1 << n)])
            found[whole[mine]] += least
        return found


def _agreeing(words: np.ndarray, i: np.ndarray, q: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs ``(i, i + q)`` agree in their first words, as many as are needed but 13 at most."""
    alive = np.arange(len(i))
    for t in range(MODULUS):
        going = alive[need[alive] > t]
        if not len(going):
            break
        bad = going[words[i[going] + t] != words[i[going] + q[going] + t]]
        keep = np.ones(len(i), bool)
        keep[bad] = False
        alive = alive[keep[alive]]
    return alive


def find_runs(texts: list[np.ndarray], shortest: int = 6, times: int = 4) -> list[np.ndarray]:
    """For each text, given as codes of its words from 0, the rows ``(start, length, period)`` of its runs, by start, then period.

    Runs have at least ``shortest`` words and ``times`` periods; ``times`` is 3 or more.
    """
    out = [np.empty((0, 3), np.int64)] * len(texts)
    order = sorted((n for n, t in enumerate(texts) if len(t) >= max(shortest, times)), key=lambda n: -len(texts[n]))
    block: list[int] = []
    held = 0
    for n in order + [None]:
        if block and (n is None or held + len(texts[n]) > BLOCK):
            for doc, runs in _block_runs([texts[b] for b in block], shortest, times):
                out[block[doc]] = runs
            block, held = [], 0
        if n is not None:
            block.append(n)
            held += len(texts[n])
    return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one behind the other, a value of its own before each and behind the last, and where each text starts."""
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    words = np.empty(starts[-1], np.int64)
    words[starts - 1] = -1 - np.arange(len(starts))
    for start, text in zip(starts, texts):
        words[start:start + len(text)] = text
    return words, starts


def _block_runs(texts: list[np.ndarray], shortest: int, times: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of texts that stand in order of falling length, for those that have any."""
    words, starts = _joined(texts)
    sizes = np.array([len(t) for t in texts])
    padded = np.concatenate([words, -2 - len(starts) - np.arange(MODULUS)])
    places, periods, held = [], [], 0
    longest = int(sizes[0])
    found = []
    for q in range(1, longest // times + 1):
        last = starts[np.searchsorted(-sizes, -max(shortest, times * q), "right")]  # only texts long enough for the period
        grid = words[:last:q]
        same = grid[:-1] == grid[1:]
        at = np.flatnonzero(same[:-1] & same[1:]) * q if times >= 4 else np.flatnonzero(same) * q
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held > PAIRS:
            found.append(_from_pairs(padded, texts, starts, np.concatenate(places), np.concatenate(periods), shortest, times))
            places, periods, held = [], [], 0
    if held:
        found.append(_from_pairs(padded, texts, starts, np.concatenate(places), np.concatenate(periods), shortest, times))
    if not found:
        return
    runs = np.concatenate(found)
    # A stretch is also found with multiples of its period: the smallest stays.
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    docs, first = np.unique(runs[:, 0], return_index=True)
    for doc, own in zip(docs, np.split(runs[:, 1:], first[1:])):
        yield int(doc), own


def _from_pairs(words: np.ndarray, texts: list[np.ndarray], starts: np.ndarray, i: np.ndarray, q: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """Rows ``(text, start, length, period)`` of the runs whose first grid points are among the pairs ``(i, i + q)``."""
    # From the first grid point on at least so many words agree with those one period later.
    need = np.maximum((times - 2) * q + 1, shortest - 2 * q + 1)
    keep = _agreeing(words, i, q, need)
    if not len(keep):
        return np.empty((0, 4), np.int64)
    i, q, need = i[keep], q[keep], need[keep]
    # Only texts with such pairs are sorted.
    of = np.searchsorted(starts, i, "right") - 1
    touched, number = np.unique(of, return_inverse=True)
    own, own_starts = _joined([texts[t] for t in touched])
    at = i - starts[of] + own_starts[number]
    ahead = Extensions(own)(at, at + q)
    enough = np.flatnonzero(ahead >= need)
    at, q, ahead, number = at[enough], q[enough], ahead[enough], number[enough]
    if not len(at):
        return np.empty((0, 4), np.int64)
    size = len(own)
    behind = Extensions(own[::-1].copy())(size - at, size - at - q)
    start, length = at - behind, behind + q + ahead
    right = np.flatnonzero((behind < q) & (length >= np.maximum(shortest, times * q)))
    number, start, length, q = number[right], start[right], length[right], q[right]
    return np.unique(np.stack([touched[number], start - own_starts[number], length, q], axis=1), axis=0)


def dropped_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:size] > 0


def word_codes(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The words of texts, a number for each distinct one, and where the words of each text start."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[real]
    words = words.filter(pa.array(real))
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False), starts


def collapse_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", shortest: int = 6, times: int = 4) -> DataFrame:
    """Add the runs of each whole text, and the text without their repetitions.

    ``runs`` is an array of ``(start, length, period)`` in words, by start, then
    period; ``collapsed`` holds the words that lie in no run behind its first
    period, joined by single spaces.  Words are runs of anything but ASCII white
    space.  Null and empty texts, and texts without words, have no runs and
    collapse to the empty text.  All other columns stay, whatever their names;
    columns named like the two are replaced.  Rows are independent, so ties,
    repeated rows and empty tables need no rule.  Memory grows with the longest
    text of a batch, not with the table.
    """
    plain = docs.drop(runs, collapsed)
    place = plain.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes, starts = word_codes(batch.column(place))
            texts = [codes[a:b] for a, b in zip(starts, starts[1:])]
            found = find_runs(texts, shortest, times)
            keep = np.ones(len(words), bool)
            for n, own in enumerate(found):
                if len(own):
                    keep[starts[n]:starts[n + 1]] = ~dropped_words(len(texts[n]), own)
            ends = np.concatenate([[0], np.cumsum(keep)])[starts]
            short = pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string())).cast(pa.string())
            rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            columns = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(kind.value_type))
            offsets = np.cumsum([0] + [len(own) for own in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, columns), short],
                                             names=[*batch.schema.names, runs, collapsed])

    return plain.mapInArrow(collapse, extended(plain.schema, f"`{runs}` array<struct<start: long, length: long, period: long>>, `{collapsed}` string"))
