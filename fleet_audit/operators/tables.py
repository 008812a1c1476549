"""Profile tables and their layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleet_audit.operators.thresholds import with_thresholds

_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}
_LONG_TEXT = 64


def _bytes(field: T.StructField) -> Column:
    """Bytes of one value; 0 for NULL."""
    column, kind = F.col(f"`{field.name}`"), type(field.dataType)
    if kind in (T.StringType, T.BinaryType):
        size = F.octet_length(column).cast("long")
    elif kind is T.ArrayType:
        size = F.array_size(column).cast("long") * _WIDTHS.get(type(field.dataType.elementType), 8)
    else:
        size = F.when(column.isNotNull(), _WIDTHS.get(kind, 8)).cast("long")
    return F.coalesce(size, F.lit(0).cast("long"))


def _identity(field: T.StructField) -> Column:
    """A value to count distinct ones by; long text is replaced by its SHA-256 digest.

    The length goes along, so a digest never meets a short text of the same letters.
    """
    column = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.StringType):
        return column
    return F.struct(
        F.octet_length(column).alias("n"),
        F.when(F.octet_length(column) > _LONG_TEXT, F.sha2(column, 256)).otherwise(column).alias("v"),
    )


def _approximate(df: DataFrame) -> DataFrame:
    """All columns in one pass with sketches: one shuffled row per task."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        aggregates += [
            F.approx_count_distinct(column).alias(f"ndv_{i}"),
            F.count_if(column.isNull()).alias(f"nulls_{i}"),
            F.coalesce(F.sum(_bytes(field)), F.lit(0)).alias(f"size_{i}"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"), F.col(f"ndv_{i}").alias("ndv"),
            F.col(f"nulls_{i}").alias("nulls"), F.col(f"size_{i}").alias("size"),
        )
        for i, f in enumerate(df.schema.fields)
    ])
    return df.agg(*aggregates).select("rows", F.explode(rows).alias("_c")).select(
        F.col("rows").alias("row_count"), "_c.*"
    )


def _exact(df: DataFrame) -> DataFrame:
    """Each column on its own: distinct values first, combined on the map side.

    Every branch reads one column, and a frequent value is one row per task, so neither
    wide rows nor hot values are shuffled.
    """
    branches = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        values = df.groupBy(_identity(field).alias("_v"), column.isNull().alias("_null")).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(_bytes(field)).alias("_bytes")
        )
        branches.append(values.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.lit(field.name).alias("column_name"),
            F.count_if(~F.col("_null")).alias("ndv"),
            F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum("_bytes"), F.lit(0)).alias("size"),
        ))
    return reduce(DataFrame.unionByName, branches)


def table_stats(df: DataFrame, table_id: str, exact: bool = False) -> DataFrame:
    """``table_id, row_count, column_name, ndv, nulls, size`` measured on any DataFrame.

    NDV is a sketch unless ``exact``.
    """
    measured = _exact(df) if exact else _approximate(df)
    return measured.select(F.lit(table_id).alias("table_id"), "row_count", "column_name", "ndv", "nulls", "size")


def stats_stale(recorded: DataFrame, measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``table_id, recorded_rows, measured_rows, stats_stale`` by the relative difference."""
    sides = [
        side.groupBy("table_id").agg(F.max("row_count").alias(name))
        for side, name in ((recorded, "recorded_rows"), (measured, "measured_rows"))
    ]
    # A table on one side only has no difference to measure, so what is recorded of it is stale.
    joined = sides[0].join(sides[1], "table_id", "full_outer")
    off = F.abs(F.col("recorded_rows") - F.col("measured_rows")) > (
        F.col("threshold") * F.greatest(F.col("measured_rows"), F.lit(1))
    )
    return with_thresholds(joined, thresholds, "stats_stale", "relative_difference").select(
        "table_id", "recorded_rows", "measured_rows", F.coalesce(off, F.lit(True)).alias("stats_stale")
    )


def partition_info(table_files: DataFrame) -> DataFrame:
    """``table_id, partition_count, files, avg_file_bytes, format`` (the most frequent).

    Counted first per partition and format, so a large table is spread over all tasks.
    """
    cells = table_files.groupBy("table_id", "part", "format").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )
    formats = cells.groupBy("table_id", "format").agg(F.sum("n").alias("n"))
    usual = formats.groupBy("table_id").agg(
        F.min_by("format", F.struct((-F.col("n")).alias("n"), F.col("format").alias("f"))).alias("format")
    )
    return (
        cells.groupBy("table_id")
        .agg(
            F.countDistinct("part").alias("partition_count"), F.sum("n").alias("files"),
            F.sum("bytes").alias("bytes"),
        )
        .join(usual, "table_id", "left")
        .select("table_id", "partition_count", "files", (F.col("bytes") / F.col("files")).alias("avg_file_bytes"), "format")
    )
