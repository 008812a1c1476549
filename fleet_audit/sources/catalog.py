"""Rule catalogue, scope map and thresholds as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit import fixed_values, schemas
from fleet_audit.functions.text import doc_parts
from fleet_audit.functions.versions import gate_array, gate_label


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON files, one array or one object per line, one row per rule."""
    return prepare_rules(spark.read.schema(schemas.RULE_RECORD).option("multiLine", True).json(path))


def prepare_rules(records: DataFrame) -> DataFrame:
    """Catalogue records as the ``rules`` table: gate and document reference split."""
    gate = F.col("applies_to.engine_version")
    doc = doc_parts(F.col("source"))
    return records.select(
        F.col("id").alias("rule_id"),
        "domain",
        F.col("applies_to.role").alias("role"),
        gate.alias("engine_version"),
        gate_array(gate).alias("gates"),
        "property", "check", "severity", "rationale", "source",
        doc["source"].alias("doc_source"),
        doc["page"].alias("doc_page"),
        gate_label(gate).alias("doc_version"),
    )


def default_scope_map(spark: SparkSession) -> DataFrame:
    rows = [(signal, list(scopes)) for signal, scopes in fixed_values.SCOPE_SIGNALS]
    return spark.createDataFrame(rows, schemas.SCOPE_MAP)


def read_scope_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCOPE_MAP).json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.THRESHOLDS).json(path)
