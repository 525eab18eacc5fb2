"""Bracket index of source text: which opening bracket closes where, at any depth.

Matching brackets is what regular expressions cannot do, so it is done once per
file in an Arrow batch function, in time linear in the text.  Only texts that
hold a head of a block rule are sent there.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# String literals, which may hold brackets of no account, and brackets.
_TOKENS = re.compile(r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\[\s\S])*+`|[()\[\]{}]''')
_CLOSES = {")": "(", "]": "[", "}": "{"}

# Tasks get this module with the function, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "array<array<struct<line:int,matched:string,value:string>>>"


@dataclass(frozen=True)
class Block:
    """What follows the head that a rule's pattern finds: an object behind ``link``.

    ``levels`` of the object's content are kept, what lies deeper is left out and
    its brackets stand empty.  Without the object a head counts only if the
    object is not ``required``.
    """

    link: str = ""
    levels: int = 1
    required: bool = False


class Brackets:
    """The bracket pairs of one text, outside string literals.

    A closing bracket that does not fit the last open one is passed over; an
    opening one that nothing closes has no pair.
    """

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def pairs(self) -> tuple[list[int], list[int], list[int]]:
        """Places of opening brackets in order, of the ends of their pairs, and how many open before that end; -1 where there is none."""
        opens: list[int] = []
        ends: list[int] = []
        within: list[int] = []
        stack: list[int] = []
        for token in _TOKENS.finditer(self.text):
            at = token.start()
            kind = self.text[at]
            if kind in "([{":
                stack.append(len(opens))
                opens.append(at)
                ends.append(-1)
                within.append(-1)
            elif kind in _CLOSES and stack and self.text[opens[stack[-1]]] == _CLOSES[kind]:
                mine = stack.pop()
                ends[mine], within[mine] = at, len(opens)
        return opens, ends, within

    def outline(self, at: int, levels: int) -> str | None:
        """The pair that opens at ``at`` with its content down to ``levels``; None if nothing closes it."""
        opens, ends, within = self.pairs
        first = bisect_left(opens, at)
        if first == len(opens) or opens[first] != at or ends[first] < 0:
            return None
        out: list[str] = []
        written, n, stop = at, first + 1, [ends[first]]
        while n < within[first]:
            while opens[n] > stop[-1]:
                stop.pop()
            if ends[n] < 0:
                n += 1
            elif len(stop) == levels:
                out += [self.text[written:opens[n] + 1]]
                written, n = ends[n], within[n]  # what lies between is not looked at
            else:
                stop.append(ends[n])
                n += 1
        return "".join(out) + self.text[written:ends[first] + 1]


def block_hits(text: str, rules: Sequence[tuple[re.Pattern, int, re.Pattern, Block]]) -> list[list[tuple[int, str, str]]]:
    """For each rule the ``(line, matched, value)`` of its heads in a text, nested ones included."""
    brackets = Brackets(text)
    lines: list[int] | None = None
    out = []
    for head, group, link, block in rules:
        found = []
        for match in head.finditer(text):
            start, end = match.span()
            joint = link.match(text, end)
            outline = brackets.outline(joint.end(), block.levels) if joint and text[joint.end():joint.end() + 1] == "{" else None
            if outline is None and block.required:
                continue
            if lines is None:
                lines = [m.start() for m in re.finditer("\n", text)]
            matched = text[start:end] if outline is None else text[start:joint.end()] + outline
            found.append((bisect_left(lines, start) + 1, matched, match.group(group) if group else matched))
        out.append(found)
    return out


def find_blocks(text: Column, heads: Sequence[tuple[str, int, Block]]) -> Column:
    """For every ``(pattern, group, block)`` the hits in a text; null for a null text.

    Patterns are read by Python, so they keep to what both engines share.
    """
    rules = [(pattern, group, block.link, block) for pattern, group, block in heads]

    @pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        compiled = [(re.compile(pattern), group, re.compile(link), block) for pattern, group, link, block in rules]
        return texts.map(lambda t: None if t is None else [[dict(line=n, matched=m, value=v) for n, m, v in own] for own in block_hits(t, compiled)])

    return hits(text)
