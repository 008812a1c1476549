"""Build rows of the ``findings`` and ``notes`` tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit import schemas


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _struct(kinds: dict[str, str], values: dict) -> Column:
    unknown = set(values) - set(kinds)
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)}")
    return F.struct(
        *[_as_column(values.get(name)).cast(kind).alias(name) for name, kind in kinds.items()]
    )


def to_findings(
    df: DataFrame,
    *,
    rule_id,
    severity,
    rationale,
    property=None,
    actual=None,
    expected=None,
    fleet=None,
    cluster=None,
    rationale_source="rule_catalog",
    doc_ref: dict | None = None,
    **evidence,
) -> DataFrame:
    """Project ``df`` to the findings schema; plain values become literals."""
    texts = {
        "fleet": fleet,
        "cluster": cluster,
        "rule_id": rule_id,
        "severity": severity,
        "property": property,
        "actual": actual,
        "expected": expected,
        "rationale": rationale,
        "rationale_source": rationale_source,
    }
    return df.select(
        *[_as_column(value).cast("string").alias(name) for name, value in texts.items()],
        _struct(schemas.EVIDENCE_FIELDS, evidence).alias("evidence"),
        _struct(schemas.DOC_REF_FIELDS, doc_ref or {}).alias("doc_ref"),
    )


def to_notes(df: DataFrame, *, kind, property, text, severity, cluster=None) -> DataFrame:
    """Project ``df`` to the notes schema. Notes never enter ``findings``."""
    return df.select(
        *[
            _as_column(value).cast("string").alias(name)
            for name, value in {
                "kind": kind,
                "cluster": cluster,
                "property": property,
                "text": text,
                "severity": severity,
            }.items()
        ]
    )


def all_findings(*parts: DataFrame) -> DataFrame:
    """One findings table out of many; no shuffle, duplicates are kept."""
    return reduce(DataFrame.unionByName, parts)


def flatten(findings: DataFrame) -> DataFrame:
    """Evidence and document reference as plain columns, for export to flat stores."""
    return findings.select(
        *[c for c in findings.columns if c not in ("evidence", "doc_ref")],
        *[F.col(f"evidence.{f}").alias(f"evidence_{f}") for f in schemas.EVIDENCE_FIELDS],
        *[F.col(f"doc_ref.{f}").alias(f"doc_{f}") for f in schemas.DOC_REF_FIELDS],
    )


def rule_id_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rule ids (per cluster) found on one side only, with the side; empty when equal.

    Counts are compared, not rows paired: each side is pre-aggregated before the
    shuffle, so a rule that fired everywhere costs one row per map task.
    """
    keys = ["cluster", "rule_id"]
    sides = a.select(*keys, F.lit(1).alias("side")).unionAll(b.select(*keys, F.lit(-1).alias("side")))
    return (
        sides.groupBy(*keys)
        .agg(F.sum("side").alias("surplus"))
        .where("surplus <> 0")
        .select(*keys, F.when(F.col("surplus") > 0, "first").otherwise("second").alias("only_in"),
                F.abs("surplus").alias("times"))
    )
