"""A dynamic filter removes hardly any rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import plain_number
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "ineffective_dynamic_filter"
INPUTS = ("dynamic_filters",)


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    filters = (
        tables["dynamic_filters"]
        .where("input_rows > 0")
        .select("fleet", "cluster", "query_id", "filter_id",
                ((F.col("input_rows") - F.col("output_rows")) / F.col("input_rows")).alias("reduction"))
    )
    fired = with_thresholds(filters, thresholds, NAME, "reduction").where("reduction < threshold")
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="low", property="dynamic filter reduction",
        actual=F.concat(plain_number(F.col("reduction") * 100), F.lit("%")),
        expected=F.concat(F.lit("at least "), plain_number(F.col("threshold") * 100), F.lit("%")),
        rationale="The filter costs time to build and removes hardly any rows.",
        query_id=F.col("query_id"), operator_id=F.col("filter_id"), metric="reduction",
        value=F.col("reduction"), threshold=F.col("threshold"),
    )
