"""Exports of table statistics and of partition, file and manifest listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partition keys are text: dates and names are as common as whole numbers.
_FILES = {"table_id": "string", "part": "string", "path": "string", "format": "string", "bytes": "bigint"}
_STATS = {"table_id": "string", "column_name": "string", "ndv": "bigint", "nulls": "bigint",
          "size": "bigint", "row_count": "bigint"}


def _shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The known columns, and the cluster of the table where the export names it."""
    if "cluster" in df.columns:
        columns = {"cluster": "string", **columns}
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()
    ])


def read_table_metadata(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``column_stats`` and ``table_files`` from exports below ``path`` (parquet)."""
    root = path.rstrip("/")
    return {
        "column_stats": _shaped(spark.read.parquet(f"{root}/column_stats"), _STATS),
        "table_files": combine_listings(
            spark.read.parquet(f"{root}/partitions"), spark.read.parquet(f"{root}/files")
        ),
    }


def combine_listings(partitions: DataFrame, files: DataFrame) -> DataFrame:
    """One ``table_files`` table out of partition listings and file or manifest listings.

    A partition listing has no file path; columns either form lacks are NULL.
    """
    both = partitions.unionByName(files, allowMissingColumns=True)
    return _shaped(both, _FILES)
