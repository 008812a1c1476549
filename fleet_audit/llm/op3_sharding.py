"""The registered query of :mod:`fleet_audit.llm.balanced_shards`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.balanced_shards import balanced_shards
from fleet_audit.llm.shared import table

SHARDS = 40


def op3_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards(table(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)
    return placed.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
