"""A query spilled to disk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import human_bytes
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "spilling"
INPUTS = ("operators",)


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    spilled = (
        tables["operators"]
        .groupBy("fleet", "cluster", "query_id")
        .agg(F.sum("spilled_bytes").cast("double").alias("bytes"))
        .where("bytes > 0")
    )
    fired = with_thresholds(spilled, thresholds, NAME, "spilled_bytes").where("bytes > threshold")
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="medium", property="spilled bytes",
        actual=human_bytes(F.col("bytes")),
        expected=F.concat(F.lit("at most "), human_bytes(F.col("threshold"))),
        rationale="The query ran out of memory and wrote intermediate data to disk.",
        query_id=F.col("query_id"), metric="spilled_bytes", value=F.col("bytes"),
        threshold=F.col("threshold"),
    )
