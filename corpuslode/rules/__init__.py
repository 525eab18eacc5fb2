"""The rule catalogue by family."""

from __future__ import annotations

from . import access, backend, crypto, injection, misconfiguration, mobile, patterns, practices, react, vue
from .model import Clause, Rule, has, lacks, numbered

# Fixed value: the order in which families win when they report the same place.
FAMILY_ORDER = ["dependencies", "injection", "crypto", "access", "misconfiguration", "mobile", "react", "vue", "backend"]

FAMILIES: dict[str, list[Rule]] = {
    "injection": injection.RULES,
    "crypto": crypto.RULES,
    "access": access.RULES,
    "misconfiguration": misconfiguration.RULES,
    "mobile": mobile.RULES,
    "react": react.RULES,
    "vue": vue.RULES,
    "backend": backend.RULES,
}
PRACTICES: list[Rule] = practices.RULES
PATTERNS: list[Rule] = patterns.RULES


def security_rules() -> list[Rule]:
    return [rule for rules in FAMILIES.values() for rule in rules]


__all__ = ["Clause", "Rule", "has", "lacks", "numbered", "FAMILIES", "FAMILY_ORDER", "PRACTICES", "PATTERNS", "security_rules"]
