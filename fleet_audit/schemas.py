"""Table schemas shared by sources, operators and streams."""

from __future__ import annotations

CONFIG_FILES = (
    "cluster string, role string, node string, file string, content string, "
    "modified_at timestamp"
)

CONFIG_ENTRIES = (
    "cluster string, role string, node string, file string, line int, key string, raw string"
)

#: One catalogue entry as stored on disk (one JSON object per rule).
RULE_RECORD = (
    "id string, domain string, applies_to struct<role: string, engine_version: string>, "
    "property string, `check` string, severity string, rationale string, source string"
)

THRESHOLDS = "detector string, fleet string, name string, value double"

SCOPE_MAP = "signal string, scopes array<string>"

CONTEXT_RECORD = (
    "cluster string, source string, properties map<string, string>, "
    "passages array<struct<text: string, doc: string, page: int>>, "
    "engine_version_hint string"
)

PASSAGES = "passage_id string, text string, source_doc string, page int, engine_version string"

EVIDENCE_FIELDS = {
    "file": "string", "line": "int", "query_id": "string", "stage_id": "string", "operator_id": "string",
    "table": "string", "metric": "string", "value": "double", "threshold": "double", "cause": "string",
}
DOC_REF_FIELDS = {"source": "string", "version": "string", "page": "int", "anchor": "string"}


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in fields.items()) + ">"


EVIDENCE = _struct(EVIDENCE_FIELDS)
DOC_REF = _struct(DOC_REF_FIELDS)

FINDINGS = (
    "fleet string, cluster string, rule_id string, severity string, property string, "
    "actual string, expected string, rationale string, rationale_source string, "
    f"evidence {EVIDENCE}, doc_ref {DOC_REF}"
)

NOTES = "kind string, cluster string, property string, text string, severity string"

#: A query document as saved on completion. ``document`` is the JSON text.
SNAPSHOT_RECORD = (
    "fleet string, cluster string, query_id string, captured_at timestamp, snapshot_id long, document string"
)

SEVERITIES = ("high", "medium", "low")
