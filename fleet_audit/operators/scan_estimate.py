"""What the scans of a workload would read, before anything is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleet_audit.functions.text import human_bytes
from fleet_audit.operators.thresholds import with_thresholds

#: Partition keys per block of the running sums.
_BLOCK = 4096


def _running_bytes(table_files: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bytes and partitions of a table up to and including each bound.

    A running sum over all partitions of a table would put a large table into one
    task. Sums run inside blocks of neighbouring keys, and over the block totals.
    """
    cells = (
        table_files.groupBy("table_id", "part").agg(F.sum("bytes").cast("long").alias("bytes"))
        .withColumn("parts", F.lit(1).cast("long"))
        .select("table_id", F.col("part").alias("at"), "bytes", "parts")
        .unionByName(bounds.select(
            "table_id", "at", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("parts")))
        .groupBy("table_id", "at").agg(F.sum("bytes").alias("bytes"), F.sum("parts").alias("parts"))
        .withColumn("block", F.floor(F.col("at") / _BLOCK))
    )
    blocks = cells.groupBy("table_id", "block").agg(F.sum("bytes").alias("bytes"), F.sum("parts").alias("parts"))
    earlier = Window.partitionBy("table_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "table_id", "block",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("parts").over(earlier), F.lit(0)).alias("parts_before"),
    )
    within = Window.partitionBy("table_id", "block").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        cells.withColumns({"bytes": F.sum("bytes").over(within), "parts": F.sum("parts").over(within)})
        .join(offsets, ["table_id", "block"])
        .select("table_id", "at", (F.col("bytes") + F.col("bytes_before")).alias("bytes_to"),
                (F.col("parts") + F.col("parts_before")).alias("parts_to"))
    )


def column_share(column_stats: DataFrame, scan_columns: DataFrame) -> DataFrame:
    """Share of a table's bytes that the columns a scan names make up.

    ``scan_columns`` has one row per scan and column; tables without sizes give no row.
    """
    sizes = column_stats.groupBy("table_id", "column_name").agg(F.max("size").alias("size"))
    total = sizes.groupBy("table_id").agg(F.sum("size").alias("total")).where("total > 0")
    return (
        scan_columns.select("scan_id", "table_id", "column_name").distinct()
        .join(sizes, ["table_id", "column_name"])
        .groupBy("scan_id", "table_id").agg(F.sum("size").alias("read"))
        .join(total, "table_id")
        .select("scan_id", "table_id", (F.col("read") / F.col("total")).alias("share"))
    )


_FIRST_KEY, _LAST_KEY = -(1 << 62), 1 << 62


def estimate_scan(
    scans: DataFrame, table_files: DataFrame, thresholds: DataFrame, shares: DataFrame | None = None
) -> DataFrame:
    """``scan_id, table_id, partitions, estimated_scan_bytes, estimated_cost, safe_to_run, warnings``.

    Listings whose keys are no whole numbers count as not listed, so a scan of them is not called safe.
    ``scans`` covers partition keys ``low`` to ``high`` (whole numbers, both inclusive) of a
    table; a NULL bound is an open end. Each distinct range is answered from two running sums, so scans are never
    paired with partitions. Cost is bytes times the share of the columns read.
    """
    table_files = table_files.withColumn("part", F.col("part").try_cast("bigint")).where("part is not null")
    # An open end, given as NULL, reaches to the end of all keys.
    scans = scans.withColumns({"low": F.coalesce(F.col("low").cast("bigint"), F.lit(_FIRST_KEY)), "high": F.coalesce(F.col("high").cast("bigint"), F.lit(_LAST_KEY))})
    ranges = scans.select("table_id", "low", "high").distinct()
    ends = F.array(
        F.struct((F.col("low") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("high").alias("at"), F.lit(1).alias("sign"))
    )
    bounds = ranges.select("table_id", "low", "high", F.explode(ends).alias("_e")).select("table_id", "low", "high", "_e.*")
    sums = _running_bytes(table_files, bounds.select("table_id", "at"))
    difference = lambda c: F.greatest(F.sum(F.col(c) * F.col("sign")), F.lit(0))
    sized = bounds.join(sums, ["table_id", "at"]).groupBy("table_id", "low", "high").agg(
        difference("bytes_to").alias("estimated_scan_bytes"), difference("parts_to").alias("partitions")
    )
    known = table_files.select("table_id").distinct().withColumn("listed", F.lit(True))
    estimated = scans.join(sized, ["table_id", "low", "high"]).join(known, "table_id", "left")
    if shares is None:
        estimated = estimated.withColumn("share", F.lit(1.0))
    else:
        estimated = estimated.join(shares, ["scan_id", "table_id"], "left")
    limited = with_thresholds(estimated, thresholds, "estimate_scan", "scan_bytes")
    over = F.col("estimated_scan_bytes") > F.col("threshold")
    unknown = F.col("listed").isNull()
    warnings = F.array_compact(F.array(
        F.when(over, F.concat(F.lit("reads "), human_bytes(F.col("estimated_scan_bytes")), F.lit(", limit "),
                              human_bytes(F.col("threshold")))),
        F.when(unknown, F.lit("no file listing for the table")),
        F.when(~unknown & (F.col("partitions") == 0), F.lit("no partition in range")),
        F.when(F.col("share").isNull(), F.lit("column sizes unknown, all columns assumed")),
    ))
    return limited.select(
        "scan_id", "table_id", "partitions", "estimated_scan_bytes",
        (F.col("estimated_scan_bytes") * F.coalesce("share", F.lit(1.0))).alias("estimated_cost"),
        (~over & ~unknown).alias("safe_to_run"), warnings.alias("warnings"),
    )
