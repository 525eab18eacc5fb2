"""Byte-level BPE that finds the exact merges by longest matches and backtracking.

A sequence of tokens is what the merges give exactly when each two neighbours
are: their joined bytes merge back into the same two.  So a piece is cut into
longest matches from the left, a token giving way to a shorter one, or to its
predecessor, when it does not suit its neighbour; positions from which no way
leads on are not visited twice, which keeps the work linear.  Matches come from
an Aho-Corasick automaton over the bytes read as Latin-1.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import Memo, extended, units

# Entries a Python worker keeps: text between spaces, matches of the pattern, and pairs of neighbours.
UNITS = 700_000
PIECES = 500_000
PAIRS = 400_000
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, base64 and id per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(piece: str, ranks: dict[str, int], stop: str = "") -> list[str]:
    """The merges by definition: the pair of lowest rank first, the leftmost of equals; the one that makes ``stop`` is left undone."""
    parts = list(piece)
    while len(parts) > 1:
        offers = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        best = min(offers)
        if best == _NEVER:
            break
        i = offers.index(best)
        joined = parts[i] + parts[i + 1]
        if joined == stop:
            break
        parts[i:i + 2] = [joined]
    return parts


class ByteBpe:
    """Encoder and decoder for one rank file and one pattern that splits text into pieces.

    Inside, bytes are characters of Latin-1, as the automaton reads them.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.widest = max(map(len, self.ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        # Facts of tokens, at most one entry each; the first also of starts of tokens.
        self.shorter = Memo(self.longest_prefix, 4 * len(ranks), longest=_NEVER)
        self.halves = Memo(self.last_merge, len(ranks), longest=_NEVER)
        self.steady = Memo(self.is_steady, len(ranks), longest=_NEVER)
        self.ends = Memo(lambda token: self.edge(token, 1), len(ranks), longest=_NEVER)
        self.starts = Memo(lambda token: self.edge(token, 0), len(ranks), longest=_NEVER)
        self.pairs = Memo(lambda pair: self.suits(*pair), PAIRS)
        self.piece_ids = Memo(self.encode_piece, PIECES)
        self.unit_ids = Memo(self.encode_unit, UNITS)

    def longest_prefix(self, token: str) -> str:
        """The longest token that a string starts with, itself apart; empty if there is none."""
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), "")

    def longest(self, text: str, at: int) -> str:
        """The longest token that ``text`` has at a place, empty if there is none; the automaton says how far any token could reach."""
        rest = text[at:at + self.widest]
        rest = rest[:self.automaton.longest_prefix(rest)]
        return rest if rest in self.ranks else self.shorter[rest]

    def last_merge(self, token: str) -> tuple[str, str] | None:
        """The two parts that the merges join last to get a token; None for a single byte, or if they do not get there."""
        parts = merged(token, self.ranks, token)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def is_steady(self, token: str) -> bool:
        """Whether the token's merges come in the order of their ranks, those of its parts before its own."""
        if len(token) == 1:
            return True
        parts = self.halves[token]
        return parts is not None and all(len(p) == 1 or (self.ranks[p] < self.ranks[token] and self.steady[p]) for p in parts)

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end of a token while it is merged, from its byte on, each with the rank of the merge that takes it."""
        out, until = [(token, _NEVER)], _NEVER
        while len(token) > 1:
            until, token = self.ranks[token], self.halves[token][side]
            out.append((token, until))
        return out[::-1]

    def suits(self, left: str, right: str) -> bool:
        """Whether the merges of two tokens' joined bytes give these two again.

        They do unless something at the end of the left one merges with something
        at the start of the right one while both stand there.  Of equal ranks the
        left merge comes first.
        """
        ranks = self.ranks
        if not left:
            return self.steady[right] or merged(right, ranks) == [right]
        if not (self.steady[left] and self.steady[right]):
            return merged(left + right, ranks) == [left, right]
        ends, starts = self.ends[left], self.starts[right]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            rank = ranks.get(a + b)
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if a_until <= b_until:
                if a_until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece: the piece itself if it is a token, else what the merges give."""
        text, ranks = piece.encode().decode("latin-1"), self.ranks
        if text in ranks:
            return [ranks[text]]
        pairs, shorter, found, closed = self.pairs, self.shorter, [""], set()  # nothing stands before the first token
        at, token, size = 0, self.longest(text, 0), len(text)
        while at < size:
            before = found[-1]
            while token and (closed and at + len(token) in closed or not pairs[before, token]):
                token = shorter[token]
            if token:
                found.append(token)
                at += len(token)
                token = self.longest(text, at)
            elif at:
                closed.add(at)
                token = found.pop()
                at -= len(token)
                token = shorter[token]
            else:
                raise ValueError("the ranks lack a byte of the text")
        return [ranks[token] for token in found[1:]]

    def encode_unit(self, unit: str) -> list[int]:
        pieces = self.pieces.findall(unit)
        if len(pieces) == 1:
            return self.encode_piece(pieces[0])  # kept with the unit
        return [i for piece in pieces for i in self.piece_ids[piece]]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern encoded by itself.

        Repeated units of the text are looked up.
        """
        ids: list[int] = []
        for unit in map(self.unit_ids.__getitem__, units(text)):
            ids += unit
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder per rank file in each Python worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the array ``out`` with the ids of each whole text; null and empty texts have none.

    All columns stay, one named ``out`` is replaced; every row is encoded by
    itself, so repeated rows and ties need no rule.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            ids = [bpe.encode(value or "") for value in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    plain = docs.drop(out)
    return plain.mapInArrow(encode, extended(plain.schema, f"`{out}` array<int>"))


def decode_documents(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the binary ``out``, the bytes that the array ``ids`` stands for; null ids give no bytes."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            values = [bpe.decode(value or []) for value in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*batch.schema.names, out])

    plain = rows.drop(out)
    return plain.mapInArrow(decode, extended(plain.schema, f"`{out}` binary"))


def digest_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row: each text encoded, and its ids decoded again.

    The ids stay in the task, so no array of them is written or sent.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        names = {rank: str(rank) for rank in bpe.tokens}
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for value in batch.column(1).to_pylist():
                ids = bpe.encode(value or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
