"""The broadcast side of a join is too large."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import human_bytes
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "bad_broadcast"
INPUTS = ("operators",)


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    builds = (
        tables["operators"]
        .where("operator = 'join' and build_bytes is not null")
        .groupBy("fleet", "cluster", "query_id", "stage_id", "operator_id")
        .agg(F.max("build_bytes").cast("double").alias("bytes"))
    )
    fired = with_thresholds(builds, thresholds, NAME, "build_bytes").where("bytes > threshold")
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="high", property="broadcast side input",
        actual=human_bytes(F.col("bytes")),
        expected=F.concat(F.lit("at most "), human_bytes(F.col("threshold"))),
        rationale="Every worker holds a copy of the broadcast side; a partitioned join fits large inputs better.",
        query_id=F.col("query_id"), stage_id=F.col("stage_id"), operator_id=F.col("operator_id"),
        metric="build_bytes", value=F.col("bytes"), threshold=F.col("threshold"),
    )
