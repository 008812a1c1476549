"""Raw settings to comparable numbers, and the choice of what is in scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.functions.bounds import bounded_rows
from fleet_audit.functions.text import normalized
from fleet_audit.sources.parsers import JVM_FILES


def normalize_values(entries: DataFrame) -> DataFrame:
    """Add ``kind, num, unit`` to every entry."""
    return normalized(entries, F.col("file").rlike(JVM_FILES))


def rules_in_scope(rules: DataFrame, scopes: list[str] | None) -> DataFrame:
    """Rules of the requested domains; no list, or ``all``, means every domain."""
    if scopes is None or "all" in scopes:
        return rules
    return rules.where(F.col("domain").isin(list(scopes)))


def scope_filter(entries: DataFrame, rules: DataFrame, scopes: list[str] | None) -> DataFrame:
    """Entries whose property some rule of the requested domains covers.

    The property list comes from the bounded catalogue, so it is a plain filter that
    reaches the scan, not a join.
    """
    wanted = bounded_rows(rules_in_scope(rules, scopes).select("property").distinct(), "the rule catalogue")
    return entries.where(F.col("key").isin([r.property for r in wanted]))
