"""The registered query of :mod:`fleet_audit.llm.line_dedup`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.line_dedup import dedup_lines
from fleet_audit.llm.shared import table


def op9_content_defined_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cleaned.select("doc_id", "removed_lines", F.length("text").cast("long").alias("chars_left"), "text")
