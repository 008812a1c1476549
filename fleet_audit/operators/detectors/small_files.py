"""A query reads many files that are small on average."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import human_bytes
from fleet_audit.operators.thresholds import Thresholds, with_thresholds

NAME = "small_files"
INPUTS = ("scan_files",)


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    sizes = (
        tables["scan_files"]
        .groupBy("fleet", "cluster", "query_id", "table_id")
        .agg(F.sum("bytes").alias("bytes"), F.count("file_id").alias("files"))
        .where("files > 0")
        .withColumn("average", F.col("bytes") / F.col("files"))
    )
    fired = with_thresholds(sizes, thresholds, NAME, "average_bytes").where("average < threshold")
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="medium", property="average file size",
        actual=F.concat(human_bytes(F.col("average")), F.lit(" over "), F.col("files").cast("string"), F.lit(" files")),
        expected=F.concat(F.lit("at least "), human_bytes(F.col("threshold"))),
        rationale="Opening files costs more than reading them; compact the table.",
        query_id=F.col("query_id"), table=F.col("table_id"), metric="average_bytes",
        value=F.col("average"), threshold=F.col("threshold"),
    )
