"""The registered query of :mod:`fleet_audit.llm.disclosure`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.disclosure import KINDS, find_disclosures, spans_text
from fleet_audit.llm.shared import table


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_disclosures(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("term"))
    counts = [
        F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return found.select(
        F.col("id").alias("doc_id"), *counts[:4], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), counts[4])


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind
