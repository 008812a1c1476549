"""A whole configuration audit: every check over every cluster, files parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleet_audit.findings import all_findings
from fleet_audit.operators import consistency, enrich, redaction, rules, versions
from fleet_audit.operators.normalize import normalize_values
from fleet_audit.sources import parsers
from fleet_audit.sources.stores import materialize


def cross_checks(entries: DataFrame, files: DataFrame, exposed: DataFrame | None = None) -> list[DataFrame]:
    """Findings of every check beside the rules, over whatever clusters are given. ``exposed``: violations among the entries, if known."""
    return [
        consistency.check_heap_mismatch(entries),
        consistency.check_catalog_hms(entries),
        consistency.check_environment_drift(entries),
        consistency.check_fleet_drift(entries),
        redaction.redaction_findings(redaction.file_violations(files, parsed=exposed)),
        redaction.refusal_findings(redaction.unverifiable(files)),
    ]


def audit_config(
    files: DataFrame,
    catalogue: DataFrame,
    context: DataFrame | None = None,
    passages: DataFrame | None = None,
    scopes: list[str] | None = None,
) -> DataFrame:
    """Findings of rules, cross-file checks and the redaction check, then enriched.

    Entries are written to the shared folder once, secrets masked, and read by every check.
    The context reaches only the version hint and the enrichment.
    """
    masked = parsers.parse_all(files).withColumns({"raw": redaction.shown_value(), "_exposed": redaction.is_exposed()})
    stored = materialize(normalize_values(masked))
    entries = stored.drop("_exposed")
    exposed = stored.where("_exposed").select("cluster", "role", "node", "file", "line", "key")
    snapshot = versions.config_snapshot(files, entries, context)
    found = all_findings(rules.run_rules(entries, catalogue, snapshot, scopes), *cross_checks(entries, files, exposed))
    if context is None and passages is None:
        return found
    return enrich.enrich(found, context, passages)
