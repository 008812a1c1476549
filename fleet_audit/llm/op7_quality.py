"""The registered query of :mod:`fleet_audit.llm.compression_quality`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.compression_quality import QualityModel, fit_quality, score_quality
from fleet_audit.llm.shared import table


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    return fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), ~held_out(F.col("doc_id")))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_quality(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
