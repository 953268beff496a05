"""Personal-data rules: the built-in patterns and the options that select them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from veilwork.functions.regex import jvm_pattern

# --- fixed values: built-in categories in order of precedence, with their patterns ---
PRECEDENCE = ("api_key", "credit_card", "ipv4", "ssn", "email", "phone")
PATTERNS = {
    "api_key": (
        r"\b(?:sk-(?:proj-)?[A-Za-z0-9_\-]{20,80}"
        r"|AKIA[0-9A-Z]{16}"
        r"|gh[pousr]_[A-Za-z0-9_]{36,255}"
        r"|(?:api[_-]?key|secret[_-]?key|access[_-]?token)[\s=:'\"]+([a-zA-Z0-9_\-]{20,64})"
        r")\b"
    ),
    "credit_card": (
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?"
        r"|5[1-5][0-9]{14}"
        r"|3[47][0-9]{13}"
        r"|6(?:011|5[0-9]{2})[0-9]{12}"
        r"|(?:4[0-9]{3}|5[1-5][0-9]{2}|6011|3[47][0-9]{2})[- ](?:[0-9]{4}[- ]){2}[0-9]{4}"
        r"|3[47][0-9]{2}[- ][0-9]{6}[- ][0-9]{5}"
        r")\b"
    ),
    "ipv4": (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b"
    ),
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": (
        r"\b(?:(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?[2-9]\d{2}[-.\s]?\d{4}"
        r"|\+\d{1,3}[-.\s]\d{1,4}[-.\s]\d{3,4}[-.\s]\d{3,4}"
        r")\b"
    ),
}
IGNORE_CASE = frozenset({"api_key", "email"})
LUHN_CATEGORY = "credit_card"
# --- end of fixed values ---

# Cheap necessary conditions in the JVM dialect.  A text that fails a rule's
# guard cannot contain a hit, so the costly pattern is not run on it.
GUARDS = {
    # case folding spelled out: a case-insensitive matcher is several times slower, and so is one that has
    # several beginnings to try at every place
    "api_key": r"[kK\u212a_](?:-|[iI\u0130\u0131][aA]|[eE][yYnN]|(?<=[pousrPOUSR\u017f]_))",
    "credit_card": r"[3-6][0-9]{3}",
    "ipv4": r"[0-9]\.[0-9]",
    "ssn": r"\p{Nd}-\p{Nd}",
    "email": r"@",
    "phone": r"\p{Nd}{4}",
}


# Letters, with those that match an ASCII letter when case is ignored.
FOLDED_LETTERS = r"A-Za-z\u0130\u0131\u017f\u212a"

# What a hit can start with, tested before the costlier word boundary and without the slow case folding.
STARTS = {
    "api_key": (  # two letters that most places fail, then all the beginnings
        r"(?=[sS\u017faAgG][kK\u212aeEpPcChH])(?:[sS\u017f](?:[kK\u212a]-|[eE][cC])"
        r"|[aA](?:[kK\u212a][iI\u0130\u0131]|[pP][iI\u0130\u0131]|[cC][cC])|[gG][hH][pousrPOUSR\u017f]_)"
    ),
    "credit_card": r"[3-6]",
    "ipv4": r"[0-9]",
    "ssn": r"\p{Nd}",
    "email": r"(?<![A-Za-z0-9_])[A-Za-z0-9_\u0130\u0131\u017f\u212a]|[.%+\-]",
    "phone": r"[+(1-9]",
}

# A sign that every hit holds, of categories whose hits hold no blank: only words with the sign are matched.
SIGNS = {"email": "@"}


def literal_start(pattern: str) -> str | None:
    """The plain text that a pattern without alternatives begins with after its word boundary, if there is any."""
    found = re.match(r"\\b([A-Za-z0-9_@ -]+)", pattern)
    if not found or "|" in pattern:
        return None
    text = found[1]
    if pattern[found.end() :][:1] in ("*", "?", "{"):
        text = text[:-1]
    return text or None


@dataclass(frozen=True)
class Rule:
    """One category with its pattern, ready for Spark."""

    category: str
    pattern: str  # Python dialect
    placeholder: str | None = None
    ignore_case: bool = False
    guard: str | None = None
    start: str | None = None
    sign: str | None = None

    @property
    def jvm(self) -> str:
        pattern = jvm_pattern(self.pattern, self.ignore_case)
        if self.category == "email" and self.pattern == PATTERNS["email"]:
            # the characters that fold into ASCII letters, in place of a slow flag
            # (no @ is in the class before it, so that nothing is to be given back)
            pattern = jvm_pattern(self.pattern).replace("A-Za-z", FOLDED_LETTERS).replace("]+@", "]++@")
        if not self.start:
            return pattern
        flags, _, rest = pattern.partition(")")
        folding = "(?iu)" if flags == "(?diu" else ""
        return f"(?d)(?={self.start}){folding}{rest}"

    @property
    def template(self) -> str:
        """Mask text with ``{idx}`` where the number goes."""
        if not self.placeholder:
            return f"[{self.category.upper()}_{{idx}}]"
        if "{idx}" in self.placeholder or "{n}" in self.placeholder:
            return self.placeholder.replace("{n}", "{idx}")
        return f"[{self.placeholder.strip('[]')}_{{idx}}]"


@dataclass(frozen=True)
class ScrubRules:
    """Which categories to mask, extra patterns, and whether a restore map is kept."""

    enabled: bool = True
    patterns: Sequence[str] = ("email", "phone", "credit_card", "ipv4", "ssn", "api_key")
    custom_patterns: Mapping[str, Any] = field(default_factory=dict)
    reversible: bool = True

    @classmethod
    def from_dict(cls, options: Mapping[str, Any]) -> ScrubRules:
        known = ("enabled", "patterns", "custom_patterns", "reversible")
        return cls(**{k: options[k] for k in known if k in options})

    @cached_property
    def ordered(self) -> tuple[Rule, ...]:
        """Custom rules as given, then the chosen built-ins by precedence."""
        if not self.enabled:
            return ()
        rules = []
        for name, spec in self.custom_patterns.items():
            pattern, placeholder = (
                (spec, None) if isinstance(spec, str) else (spec["pattern"], spec.get("placeholder"))
            )
            if re.compile(pattern).match("") is not None:
                raise ValueError(f"rule {name!r} matches the empty string: {pattern!r}")
            start = literal_start(pattern)
            rules.append(Rule(name, pattern, placeholder, guard=start, start=start))
        for name in PRECEDENCE:
            if name in self.patterns:
                rules.append(
                    Rule(
                        name,
                        PATTERNS[name],
                        None,
                        name in IGNORE_CASE,
                        GUARDS[name],
                        STARTS[name],
                        SIGNS.get(name),
                    )
                )
        return tuple(rules)

    @property
    def has_custom(self) -> bool:
        return self.enabled and bool(self.custom_patterns)

    @cached_property
    def text_guards(self) -> list[str]:
        """Patterns of which every maskable text satisfies one, the cheapest first; none if there is no such bound."""
        if self.has_custom or not self.ordered:
            return []
        needs_digit = {"credit_card", "ipv4", "ssn", "phone"} & {r.category for r in self.ordered}
        signs = [r"\p{Nd}"] if needs_digit else []
        signs += [r.sign for r in self.ordered if r.sign]
        parts = [f"[{''.join(signs)}]"] if signs else []
        return parts + [r.guard for r in self.ordered if r.category == "api_key"]

    @property
    def masks_may_collide(self) -> bool:
        """Two categories that write the same mask text; a later value then wins on restore."""
        templates = {(r.category, r.template) for r in self.ordered}
        return len({t for _, t in templates}) < len(templates)
