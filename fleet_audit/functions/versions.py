"""Versions as comparable arrays, and version gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GATE = r"(<=|>=|<|>|=)?\s*(\d+(?:[.-]\d+)*)(\+)?"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def version_array(text: Column) -> Column:
    """``413.2`` as ``[413, 2, 0]``, ``413.2.1.9`` as ``[413, 2, 1, 9]``; NULL when the first part is no number.

    All parts are kept, three at least. Zeros behind the third are left out, so that arrays compare
    as if the shorter version were padded.
    """
    def filled(parts: Column) -> Column:
        padded = F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(3) - F.size(parts), F.lit(0))))
        return F.when(F.get(parts, F.lit(0)).isNotNull(), F.transform(padded, lambda part: F.coalesce(part, F.lit(0))))

    def cut(parts: Column) -> Column:
        last = F.array_max(F.transform(parts, lambda part, i: F.when(part != 0, i + 1).otherwise(0)))
        return F.when(F.element_at(parts, -1) != 0, parts).otherwise(F.slice(parts, 1, F.greatest(last, F.lit(3))))

    # Split at one plain character, which takes no pattern.
    parts = F.split(F.translate(F.trim(text), "-", "."), r"\.").try_cast("array<int>")
    return _once(_once(parts, filled), cut)


def gate_array(gate: Column) -> Column:
    """A gate such as ``>=413, <430`` or ``413+`` as ``array<struct<op, version>>``."""
    text = F.coalesce(gate, F.lit(""))
    several = F.filter(F.split(text, r"\s*,\s*|\s+(?=[<>=])"), lambda g: F.trim(g) != "")
    single = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.transform(
        F.when(F.regexp_like(text, F.lit(r"[,\s]")), several).otherwise(single),
        lambda g: F.struct(
            _once(F.regexp_extract(g, _GATE, 1), lambda op: F.when(F.regexp_extract(g, _GATE, 3) == "+", ">=").when(op == "", "=").otherwise(op)).alias("op"),
            version_array(F.regexp_extract(g, _GATE, 2)).alias("version"),
        ),
    )


def version_in_gate(version: Column, gates: Column) -> Column:
    """True when ``version`` meets every gate; false, never NULL, when it is unknown."""
    met = _once(version, lambda v: F.forall(
        gates,
        lambda g: F.when(g.op == ">=", v >= g.version)
        .when(g.op == ">", v > g.version)
        .when(g.op == "<=", v <= g.version)
        .when(g.op == "<", v < g.version)
        .otherwise(v == g.version),
    ))
    return F.coalesce(met, F.lit(False))


def gate_label(gate: Column) -> Column:
    """Gate text as shown in a document reference: ``>=413`` becomes ``413+``."""
    return F.regexp_replace(gate, r"^\s*>=\s*([0-9.]+)\s*$", "$1+")
