"""BPE by a queue of merges over a linked list of symbols.

A piece starts as one symbol a byte.  All neighbours that can merge wait in a
heap, the lowest rank first and the leftmost of equal ranks.  A merge takes the
right symbol out of the doubly linked list and offers the two new pairs; entries
whose pair has changed since are stale and skipped.  That is the order the merge
list asks for, in O(n log n) for a piece of n bytes.  Decoding concatenates the
strings of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import Memo, extended, units

# Entries a Python worker keeps: text between spaces, and matches of the pattern.
UNITS = 500_000
PIECES = 300_000

# Fixed value: the pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A match of the pattern starts at every space behind a character that is no white space.
_STARTS = re.compile(r"(?<=\S)(?= )")
# What a file may not ask for, because nothing here does it.
_PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself where it is printable, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class MergeBpe:
    """Encoder and decoder for one tokenizer file with a byte-level BPE model.

    Files that ask for a normalizer, a prefix space, dropout, affixes, unknown
    tokens or byte fallback are refused, as are added tokens that swallow the
    white space around them.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        strange = [k for k, plain in _PLAIN.items() if (model.get(k) or None) != (plain or None)]
        strange += [k for a in added for k in ("single_word", "lstrip", "rstrip") if a[k]]
        if strange or spec["normalizer"] or model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"no plain byte-level BPE: {path} {strange}")
        symbols = byte_symbols()
        vocab = model["vocab"]
        self.bytes_of = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        # Ranks of merges by their left and right ids, and the id that each rank makes.
        self.by_left: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.made = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.by_left[vocab[left]][vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.strings = {i: self.spelled(token) for token, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in added}
        self.strings |= {i: self.spelled(content) for content, i in self.added.items()}
        # Of added tokens that start at the same place the longest one stands.
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN)
        self.names = {i: f"{i}," for i in self.strings}
        self.piece_ids = Memo(self.encode_piece, PIECES)
        self.unit_ids = Memo(self.encode_unit, UNITS)
        self.unit_digests = Memo(self.digest_unit, UNITS)

    def spelled(self, token: str) -> bytes:
        """The bytes a token stands for; one with a character that is no byte's stands for itself."""
        try:
            return bytes([self.bytes_of[c] for c in token])
        except KeyError:
            return token.encode()

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern.

        ``ranks`` holds the rank at which each symbol merges with the next one,
        -1 if it does not; a heap entry is a rank and a place in one number.
        """
        ids = [self.first[b] for b in piece.encode()]
        size, by_left, made, push, pop = len(ids), self.by_left, self.made, heapq.heappush, heapq.heappop
        ranks = [by_left[left].get(right, -1) for left, right in zip(ids, ids[1:])]
        heap = [rank * size + at for at, rank in enumerate(ranks) if rank >= 0]
        if not heap:
            return ids
        heapq.heapify(heap)
        ranks.append(-1)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        while heap:
            entry = pop(heap)
            at = entry % size
            if ranks[at] != entry // size:
                continue  # stale: another pair stands here by now
            new, gone, left = made[ranks[at]], after[at], before[at]
            right = after[gone]
            ids[at], ids[gone], ranks[gone], after[at] = new, -1, -1, right
            if right < size:
                before[right] = at
                ranks[at] = rank = by_left[new].get(ids[right], -1)
                if rank >= 0:
                    push(heap, rank * size + at)
            else:
                ranks[at] = -1
            if left >= 0:
                ranks[left] = rank = by_left[ids[left]].get(new, -1)
                if rank >= 0:
                    push(heap, rank * size + left)
        return [i for i in ids if i >= 0]

    def encode_unit(self, unit: str) -> list[int]:
        pieces = self.pieces.findall(unit)
        if len(pieces) == 1:
            return self.encode_piece(pieces[0])  # kept with the unit
        return [i for piece in pieces for i in self.piece_ids[piece]]

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text in order: stretches of ordinary text, and ids of added tokens."""
        if self.added_at is None or not self.added_at.search(text):
            yield text, None
            return
        for n, part in enumerate(self.added_at.split(text)):
            if part:
                yield part, self.added[part] if n % 2 else None

    @staticmethod
    def units_of(text: str) -> list[str]:
        """The text in units that can be tokenized by themselves."""
        found = units(text)
        return _STARTS.split(text) if len(found) == 1 else found

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of added tokens in it get the added ids."""
        ids: list[int] = []
        for part, added in self.parts(text):
            if added is not None:
                ids.append(added)
                continue
            for unit in map(self.unit_ids.__getitem__, self.units_of(part)):
                ids += unit
        return ids

    def join_strings(self, ids) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return self.join_strings(ids).decode("utf-8", "replace")

    def digest_unit(self, unit: str) -> tuple[str, bytes]:
        """The decimal ids of a unit, a comma behind each, and the bytes decoded from them."""
        ids = self.encode_unit(unit)
        return "".join([self.names[i] for i in ids]), self.join_strings(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal names, SHA-256 of the text decoded from them."""
        listed, decoded = [], []
        for part, added in self.parts(text):
            if added is not None:
                listed.append(self.names[added])
                decoded.append(self.strings[added])
            elif part:
                for names, spelled in map(self.unit_digests.__getitem__, self.units_of(part)):
                    listed.append(names)
                    decoded.append(spelled)
        ids = "".join(listed)
        value = b"".join(decoded).decode("utf-8", "replace")
        return ids.count(","), hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(value.encode()).hexdigest()


@lru_cache(maxsize=4)
def loaded(path: str) -> MergeBpe:
    """One encoder per tokenizer file in each Python worker."""
    return MergeBpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the array ``out`` with the ids of each whole text; null and empty texts have none.

    All other columns stay, whatever their names; one named ``out`` is replaced.
    Every row is encoded by itself, so ties, repeated rows and empty tables need
    no rule.
    """
    plain = docs.drop(out)
    at = plain.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [bpe.encode(value or "") for value in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return plain.mapInArrow(encode, extended(plain.schema, f"`{out}` array<int>"))


def decode_documents(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the string ``out``, the text that the array ``ids`` stands for; null ids give an empty one, null members are skipped."""
    plain = rows.drop(out)
    at = plain.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode([i for i in value or [] if i is not None]) for value in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return plain.mapInArrow(decode, extended(plain.schema, f"`{out}` string"))


def digest_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, as ``encode_documents`` and ``decode_documents`` give them.

    Ids and decoded text stay in the task.  Null texts count as empty, null ids
    stay null, repeated rows give a row each, an empty table gives none.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            found = [bpe.digest(value or "") for value in batch.column(1).to_pylist()]
            counts, ids_sha, decoded_sha = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
