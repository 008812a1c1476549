"""One task of a stage runs far longer than the median task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import ratio_text
from fleet_audit.operators.median import grouped_median
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "skew"
INPUTS = ("tasks",)


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    stages = (
        grouped_median(tables["tasks"], ["fleet", "cluster", "query_id", "stage_id"], "wall_ms")
        # A median of no time counts as one millisecond: one long task among idle ones is the worst skew, not none.
        .withColumn("ratio", F.col("max_value") / F.when(F.col("median") > 0, F.col("median")).otherwise(1.0))
    )
    limited = with_thresholds(stages, thresholds, NAME, "max_over_median")
    floor = with_thresholds(limited, thresholds, NAME, "least_wall_ms", "floor")
    fired = floor.where((F.col("ratio") > F.col("threshold")) & ((F.col("median") > 0) | (F.col("max_value") > F.coalesce("floor", F.lit(0.0)))))
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="medium", property="task wall time",
        actual=ratio_text(F.col("ratio")),
        expected=F.concat(F.lit("at most "), ratio_text(F.col("threshold")), F.lit(" the median")),
        rationale="One task does most of the stage's work; its key holds far more rows than the others.",
        query_id=F.col("query_id"), stage_id=F.col("stage_id"), metric="max_over_median",
        value=F.col("ratio"), threshold=F.col("threshold"),
    )
