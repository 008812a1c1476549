"""The registered query of :mod:`fleet_audit.llm.decontaminate`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleet_audit.llm.decontaminate import find_contamination
from fleet_audit.llm.shared import table


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
