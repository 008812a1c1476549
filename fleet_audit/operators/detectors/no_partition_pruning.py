"""A query scans (nearly) all partitions of a partitioned table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.bounds import broadcast_if_small
from fleet_audit.functions.text import plain_number
from fleet_audit.operators.predicates import classify_predicate
from fleet_audit.operators.references import table_keys
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "no_partition_pruning"
INPUTS = ("scans", "table_files")


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    scan = ["fleet", "cluster", "query_id", "table_id"]
    marked = classify_predicate(tables["scans"]).select(
        *scan, "part", F.when(F.col("predicate_class") == "wrapped_predicate", 1).alias("wrapped"),
        F.when(F.col("predicate_class") != "no_predicate", 1).alias("predicated"))
    # Partitions are counted where the rows of a scan lie together; else they are exchanged twice, once with their partition.
    scanned = marked.repartition(*scan).groupBy(*scan).agg(
        F.countDistinct("part").alias("scanned"), F.max("wrapped").alias("wrapped"), F.max("predicated").alias("predicated"))
    keys = table_keys(tables["table_files"])
    total = tables["table_files"].groupBy(*keys).agg(F.countDistinct("part").alias("total"))
    rated = with_thresholds(
        scanned.join(broadcast_if_small(total.where("total > 1")), keys).withColumn(
            "ratio", F.col("scanned") / F.col("total")
        ),
        thresholds, NAME, "scanned_ratio",
    ).where("ratio >= threshold")
    cause = (
        F.when(F.col("wrapped") == 1, "wrapped_predicate")
        .when(F.col("predicated") == 1, "other")
        .otherwise("no_predicate")
    )
    return to_findings(
        rated,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="high", property="partitions scanned",
        actual=F.concat_ws(" of ", F.col("scanned").cast("string"), F.col("total").cast("string")),
        expected=F.concat(F.lit("below "), plain_number(F.col("threshold") * 100), F.lit("% of the partitions")),
        rationale="The scan reads nearly every partition; filter on the bare partition column so that "
        "partitions can be skipped.",
        query_id=F.col("query_id"), table=F.col("table_id"), metric="scanned_ratio",
        value=F.col("ratio"), threshold=F.col("threshold"), cause=cause,
    )
