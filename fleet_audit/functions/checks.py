"""Check expressions of the rule catalogue.

A check is a Spark SQL boolean expression over a fixed list of names. Catalogue
text reaches the SQL layer, so anything but these names, numbers, quoted text and
comparison or arithmetic signs is refused when the catalogue is loaded.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Row

from fleet_audit.schemas import SEVERITIES

#: Names a check may use, and what they stand for.
NAMES = {
    "value": "the normalized number of the entry",
    "text": "the raw text of the entry",
    "jvm_heap": "heap of the node the entry belongs to, in bytes",
    "total_heap": "heap summed over the nodes of the same cluster and role, in bytes",
    "total_nodes": "number of nodes of the same cluster and role",
}
FUNCTIONS = ("least", "greatest", "abs", "lower", "upper", "length", "coalesce")
KEYWORDS = ("and", "or", "not", "in", "between", "is", "null", "like", "true", "false")

_TOKEN = re.compile(
    r"\s*(?:(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+(?:\.\d+)?)"
    r"|(?P<text>'[^'\\]*')|(?P<sign><=|>=|<>|!=|=|<|>|\+|-|\*|\(|\)|,))"
)


class CheckError(ValueError):
    """A catalogue check uses something outside the allowed list."""


def names_used(check: str) -> set[str]:
    """Entry names in a check; raises :class:`CheckError` on anything not allowed."""
    allowed = set(NAMES) | set(FUNCTIONS) | set(KEYWORDS)
    used, position = set(), 0
    stripped = check.strip()
    if not stripped:
        raise CheckError("empty check")
    while position < len(stripped):
        match = _TOKEN.match(stripped, position)
        if match is None:
            raise CheckError(f"not allowed at {position} in check: {check!r}")
        word = match["word"]
        if word is not None:
            if word.lower() not in allowed:
                raise CheckError(f"name {word!r} is not allowed in check: {check!r}")
            if word.lower() in NAMES:
                used.add(word.lower())
        position = match.end()
    return used


def typed_check(check: str) -> str:
    """The check with the sides of its comparisons brought to one type, so that no entry can make it fail.

    Raw text next to a number is read as a number and is NULL, hence not fired, where it is none; a number next to
    quoted text is compared as text.
    """
    tokens = [(match.lastgroup, match[match.lastgroup]) for match in _TOKEN.finditer(check.strip())]

    def beside(k: int, kind: str) -> bool:
        return any(
            0 <= k + step < len(tokens) and tokens[k + step][0] == "sign" and tokens[k + step][1] not in "(),"
            and 0 <= k + 2 * step < len(tokens) and tokens[k + 2 * step][0] == kind
            for step in (-1, 1))

    out = []
    for k, (kind, written) in enumerate(tokens):
        if kind == "word" and written.lower() == "text" and beside(k, "number"):
            written = "try_cast(text as double)"
        elif kind == "word" and written.lower() in ("value", "jvm_heap", "total_heap", "total_nodes") and beside(k, "text"):
            written = f"cast({written} as string)"
        out.append(written)
    return " ".join(out)


def validate_catalogue(rules: Sequence[Row]) -> dict[str, set[str]]:
    """Names used by each check; raises when a rule could not be evaluated or told apart."""
    seen: set[str] = set()
    for rule in rules:
        if rule.rule_id in seen:
            raise CheckError(f"rule id {rule.rule_id!r} is used twice")
        if rule.severity not in SEVERITIES:
            raise CheckError(f"severity {rule.severity!r} of rule {rule.rule_id!r} is not known")
        seen.add(rule.rule_id)
    return {check: names_used(check) for check in {rule.check for rule in rules}}
