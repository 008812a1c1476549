"""A query reads a table whose row count or distinct counts are unknown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.bounds import broadcast_if_small
from fleet_audit.operators.references import table_keys
from fleet_audit.operators.thresholds import Thresholds

NAME = "missing_stats"
INPUTS = ("scans", "column_stats")
ABSENT_COUNTS = ("column_stats",)


def stats_of_tables(column_stats: DataFrame) -> DataFrame:
    """One row per table: the columns without NDV, the first of them, and whether the row count is unknown."""
    return column_stats.groupBy(*table_keys(column_stats)).agg(
        F.count_if(F.col("ndv").isNull()).alias("missing_columns"),
        F.min(F.when(F.col("ndv").isNull(), F.col("column_name"))).alias("first_column"),
        F.max("row_count").isNull().alias("no_row_count"),
    )


def detect(tables: Mapping[str, DataFrame], thresholds: DataFrame | Thresholds) -> DataFrame:
    reads = tables["scans"].select("fleet", "cluster", "query_id", "table_id").distinct()
    known = broadcast_if_small(stats_of_tables(tables["column_stats"]))
    # A table without any row of statistics misses all of them.
    rated = reads.join(known, table_keys(tables["column_stats"]), "left").withColumns({
        "missing_columns": F.coalesce("missing_columns", F.lit(0)), "no_row_count": F.coalesce("no_row_count", F.lit(True))})
    fired = rated.where("missing_columns > 0 or no_row_count")
    return to_findings(
        fired,
        fleet=F.col("fleet"), cluster=F.col("cluster"),
        rule_id=NAME, severity="medium", property="table statistics",
        actual=F.concat(
            F.when(F.col("no_row_count"), "no row count, ").otherwise(""),
            F.col("missing_columns").cast("string"), F.lit(" columns without NDV"),
        ),
        expected=F.lit("row count and NDV of every column"),
        rationale="Without statistics the cost-based optimizer guesses the join order; analyze the table.",
        query_id=F.col("query_id"), table=F.col("table_id"), metric="missing_columns",
        value=F.col("missing_columns").cast("double"), threshold=F.lit(0.0),
        cause=F.coalesce(F.col("first_column"), F.lit("row_count")),
    )
