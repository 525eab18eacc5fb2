"""Rules are data: a row says what to look for, where it applies and what a hit means.

A user extends a scan by appending rules; no operator changes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.blocks import Block

FIELDS = ("path", "content", "imports", "import_part", "import_prefix", "import_named")


@dataclass(frozen=True)
class Clause:
    """One file-level test: any of the atoms holds (or, negated, none does).

    An atom is ``(field, words)``.  ``path`` and ``content`` test substrings,
    ``imports`` tests equality with an import source, ``import_part`` and
    ``import_prefix`` test a part or the start of an import source, and
    ``import_named`` tests ``source:name`` pairs.
    """

    atoms: tuple[tuple[str, tuple[str, ...]], ...]
    negated: bool = False


def _clause(fields: dict, negated: bool) -> Clause:
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown rule fields: {sorted(unknown)}")
    return Clause(tuple((name, tuple(words)) for name, words in fields.items()), negated)


def has(**fields) -> Clause:
    return _clause(fields, False)


def lacks(**fields) -> Clause:
    return _clause(fields, True)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    family: str
    title: str
    category: str = ""
    owasp: str = ""
    severity: str = ""
    status: str = "needs_fix"
    confidence: float = 1.0
    cwe: str = ""
    auto_fixable: bool = False
    polarity: str = "bad"
    pattern: str | None = None  # None: a file-level rule
    on: str = "content"  # or "code": the text without comments
    group: int = 0  # capture group that holds the judged value
    block: Block | None = None  # the pattern is a head, and the object behind it belongs to the match
    gate: tuple[str, ...] = ()  # lower-case literals every match must contain
    where: tuple[Clause, ...] = ()
    frameworks: tuple[str, ...] = ()  # empty: all
    erase: str | None = None  # removed from the value before it is judged
    keep_rx: str | None = None
    drop_rx: str | None = None
    drop: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    near: tuple[int, int, bool, tuple[str, ...]] | None = None  # lines before, after, wanted, words
    more_than: int | None = None  # count rule: one row when there are more matches
    first_only: bool = False
    line_zero: bool = False
    snippet: str = "match"  # match | masked | context | none
    snippet_chars: int | None = None
    name: str | None = None  # pattern scans: fixed name instead of the value
    kind: str = ""  # pattern scans: occurrence type

    def but(self, **changes) -> "Rule":
        return replace(self, **changes)


def numbered(prefix: str, rules: list[Rule]) -> list[Rule]:
    """Give rules without an id the next id of their family."""
    return [r.but(rule_id=f"{prefix}-{i}") for i, r in enumerate(rules, 1)]
