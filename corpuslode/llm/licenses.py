"""License scan by an exact set-similarity join.

Text blocks are joined with license templates on their token sets: a block holds
a template if at least ``threshold`` of the template's distinct tokens occur in
it.  Blocks are lines, paragraphs (lines up to one without a token), so that a
verdict does not depend on where a sentence wraps, and every run of as many
consecutive tokens as the template has, with room for others in between, so that
a sentence is found across any line ends.  Tokens are ordered by their document frequency in the whole
corpus, rarest first.  A template is indexed under the tokens of its prefix only:
a block without any of them misses too many tokens.  The length filter leaves out
blocks with too few tokens, the positional filter pairs whose remaining tokens
cannot reach the overlap; what is left is counted exactly.  Every block is a part
of its text, so a text whose token set as a whole holds no template has no block
that does.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of public licenses, as (label, text).
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")  # on lower-case bytes: letters, digits and all that is not ASCII


def tokens(text: bytes) -> list[bytes]:
    """Tokens of a text in UTF-8, A-Z in lower case."""
    return _TOKEN.findall(text.lower())


class TemplateIndex:
    """Prefix index of templates under a global token order."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: Mapping[bytes, int], threshold: float):
        sets = [(label, frozenset(tokens(text.encode()))) for label, text in templates]
        vocabulary = sorted(frozenset().union(*(s for _, s in sets)), key=lambda t: (frequency.get(t, 0), t))
        self.order = {token: i for i, token in enumerate(vocabulary)}
        self.templates = []
        self.widths: list[int] = []  # tokens of a run
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for number, (label, members) in enumerate(sets):
            ordered = sorted(members, key=self.order.__getitem__)
            least = math.ceil(threshold * len(ordered) - 1e-9)
            self.templates.append((label, members, least))
            self.widths.append(math.ceil(len(tokens(templates[number][1].encode())) / threshold - 1e-9))
            for position, token in enumerate(ordered[:len(ordered) - least + 1]):
                self.prefixes.setdefault(token, []).append((number, position))
        self.keys = frozenset(self.prefixes)

    def held(self, block: Sequence[bytes]) -> list[int]:
        """Numbers of the templates that the block holds."""
        members = frozenset(block)
        ordered = sorted(members & self.order.keys(), key=self.order.__getitem__)
        seen, found = set(), []
        for position, token in enumerate(ordered):
            for number, place in self.prefixes.get(token, ()):
                _, wanted, least = self.templates[number]
                if number in seen or len(members) < least:
                    continue
                if 1 + min(len(wanted) - place, len(ordered) - position) - 1 < least:
                    continue
                seen.add(number)
                if len(wanted & members) >= least:
                    found.append(number)
        return found

    def matches(self, block: Sequence[bytes]) -> Iterator[tuple[str, float]]:
        """Labels and shares of the templates that the block holds."""
        members = frozenset(block)
        for number in self.held(block):
            label, wanted, _ = self.templates[number]
            yield label, len(wanted & members) / len(wanted)

    def places(self, words: Sequence[bytes], starts: Sequence[int]) -> list[tuple[int, str, float]]:
        """``(line, label, share)`` of the blocks of a text that hold a template; ``starts`` has the first token of each line.

        A paragraph or a run is listed, at its first line, where it holds more
        than the listed blocks it has a part in.
        """
        out = []
        for number in self.held(words):
            label, wanted, least = self.templates[number]
            hits = [i for i, word in enumerate(words) if word in wanted]
            # Blocks as (first token, token behind the last, share), smaller kinds first.
            listed: list[tuple[int, int, float]] = []
            for blocks in (_lines(starts, len(words)), _paragraphs(starts, len(words)), _runs(words, hits, self.widths[number], least)):
                more = []
                for first, last in blocks:
                    inside = hits[bisect_left(hits, first):bisect_left(hits, last)]
                    if len(inside) < least:
                        continue
                    share = len({words[i] for i in inside}) / len(wanted)
                    if share * len(wanted) >= least - 1e-9 and not any(a < last and first < b and share <= c for a, b, c in listed):
                        more.append((first, last, share))
                listed += more
            out += [(bisect_right(starts, first) - 1, label, share) for first, _, share in listed]
        return sorted(out)


def _lines(starts: Sequence[int], end: int) -> Iterator[tuple[int, int]]:
    """Lines with a token."""
    yield from ((a, b) for a, b in zip(starts, [*starts[1:], end]) if a < b)


def _paragraphs(starts: Sequence[int], end: int) -> Iterator[tuple[int, int]]:
    """Consecutive lines with a token, as one."""
    first = None
    for a, b in zip(starts, [*starts[1:], end]):
        if a < b:
            first = a if first is None else first
        elif first is not None:
            yield first, a
            first = None
    if first is not None:
        yield first, end


def _runs(words: Sequence[bytes], hits: Sequence[int], width: int, least: int) -> Iterator[tuple[int, int]]:
    """Of every group of overlapping runs of ``width`` tokens with ``least`` distinct hits, the first that has most.

    A run that starts and ends at a hit stands for all that have the same hits.
    """
    counts: dict[bytes, int] = {}
    first, best, until = 0, None, -1
    for last, at in enumerate(hits):
        counts[words[at]] = counts.get(words[at], 0) + 1
        while hits[first] <= at - width:
            counts[words[hits[first]]] -= 1
            if not counts[words[hits[first]]]:
                del counts[words[hits[first]]]
            first += 1
        if len(counts) < least:
            continue
        if best is not None and hits[first] >= until:
            yield best[1:]
            best = None
        if best is None or len(counts) > best[0]:
            best = (len(counts), hits[first], at + 1)
        until = at + 1
    if best is not None:
        yield best[1:]


def token_frequency(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """Documents with each token of the templates, over the whole corpus; as many entries as the templates have tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for token in vocabulary.intersection(tokens(value or b"")):
                    total[token] = total.get(token, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    counted = docs.select(F.col(text).cast("binary")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in counted.collect()}


def phrase_places(words: Sequence[bytes], phrases: Mapping[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """Start and label of every place where the words of a phrase stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at:at + len(phrase)]) == phrase:
                found.append((at, label))
    return sorted(found)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
                  threshold: float = 0.9, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word``
    are their least and greatest start (null without one).  ``labels`` adds the
    labels of templates to those of phrases; both are distinct, sorted and joined
    by commas.  ``score`` is 1 with a phrase, else the greatest share of a
    template that a block holds, 0 if none reaches the threshold.  ``blocks``
    lists those blocks as ``(line, label, share)`` by their first line, lines from 0.  Null and empty
    texts have no words; rows that repeat get equal answers.
    """
    vocabulary = frozenset(t for _, body in templates for t in tokens(body.encode()))
    index = TemplateIndex(templates, token_frequency(docs, vocabulary, text), threshold)
    wanted = {tuple(tokens(p.encode())): label for p, label in phrases.items()}
    starters = {p[-1] for p in wanted}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = (value or b"").lower()
                words = _TOKEN.findall(body)
                base = phrase_places(words, wanted) if any(s in body for s in starters) else []
                blocks = []
                if not index.keys.isdisjoint(words):
                    starts = [0, *accumulate(len(_TOKEN.findall(line)) for line in body.split(b"\n"))][:-1] if index.held(words) else []
                    blocks = [{"line": line, "label": label, "share": share} for line, label, share in index.places(words, starts)] if starts else []
                own = {label for _, label in base}
                rows.append((key, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)),
                             ",".join(sorted(own | {b["label"] for b in blocks})), 1.0 if base else max((b["share"] for b in blocks), default=0.0), blocks))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                        ("blocks", pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("share", pa.float64())])))])
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                  "score double, blocks array<struct<line: long, label: string, share: double>>")
