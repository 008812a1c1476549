"""Most of the elapsed time was spent in the queue: the cluster was busy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import plain_number
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "not_the_querys_fault"
INPUTS = ("query_info",)


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    queued = (
        tables["query_info"]
        .where("elapsed_ms > 0 and queued_ms > 0")
        .select("fleet", "cluster", "query_id", "queued_ms", "elapsed_ms",
                (F.col("queued_ms") / F.col("elapsed_ms")).alias("ratio"))
    )
    fired = with_thresholds(queued, thresholds, NAME, "queued_ratio").where("ratio > threshold")
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="high", property="queued time",
        actual=F.concat(F.col("queued_ms").cast("string"), F.lit("ms of "),
                        F.col("elapsed_ms").cast("string"), F.lit("ms")),
        expected=F.concat(F.lit("at most "), plain_number(F.col("threshold") * 100), F.lit("% of elapsed")),
        rationale="The query waited for the cluster; its SQL is not what made it slow.",
        query_id=F.col("query_id"), metric="queued_ratio", value=F.col("ratio"),
        threshold=F.col("threshold"), cause="cluster_contention",
    )
