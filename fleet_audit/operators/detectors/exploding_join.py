"""A join puts out far more rows than it takes in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import ratio_text
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "exploding_join"
INPUTS = ("operators",)


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    joins = (
        tables["operators"]
        .where("operator = 'join' and input_rows > 0")
        .select("fleet", "cluster", "query_id", "stage_id", "operator_id",
                (F.col("output_rows") / F.col("input_rows")).alias("ratio"))
    )
    fired = with_thresholds(joins, thresholds, NAME, "output_ratio").where("ratio > threshold")
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="high", property="join output rows",
        actual=ratio_text(F.col("ratio")),
        expected=F.concat(F.lit("at most "), ratio_text(F.col("threshold")), F.lit(" the input rows")),
        rationale="The join multiplies its input; check for a missing join condition or repeated keys.",
        query_id=F.col("query_id"), stage_id=F.col("stage_id"), operator_id=F.col("operator_id"),
        metric="output_ratio", value=F.col("ratio"), threshold=F.col("threshold"),
    )


def join_fanout(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key an equi join of two raw tables would put out, without joining them.

    Both sides are reduced to one count per key before they meet.
    """
    counts = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
              for side, n in ((left, "left_rows"), (right, "right_rows"))]
    return (
        counts[0].join(counts[1], keys)
        .withColumn("output_rows", F.col("left_rows") * F.col("right_rows"))
        .withColumn("ratio", F.col("output_rows") / (F.col("left_rows") + F.col("right_rows")))
    )
