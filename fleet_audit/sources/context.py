"""Guidance supplied from outside, and passages of recommendation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit import schemas


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """Context objects from JSON files, one row per guided property, passage or hint."""
    return context_rows(spark.read.schema(schemas.CONTEXT_RECORD).option("multiLine", True).json(path))


def context_rows(records: DataFrame) -> DataFrame:
    """``cluster, source, kind, property, text, doc, page, engine_version_hint``.

    ``kind`` is ``property``, ``passage`` or ``hint``. A record without a cluster
    holds for all clusters.
    """
    items = F.flatten(F.array(
        F.transform(
            F.coalesce(F.map_entries("properties"), F.array()),
            lambda e: F.struct(F.lit("property").alias("kind"), e.key.alias("property"), e.value.alias("text"),
                               F.lit(None).cast("string").alias("doc"), F.lit(None).cast("int").alias("page")),
        ),
        F.transform(
            F.coalesce("passages", F.array()),
            lambda p: F.struct(F.lit("passage").alias("kind"), F.lit(None).cast("string").alias("property"),
                               p.text.alias("text"), p.doc.alias("doc"), p.page.alias("page")),
        ),
        F.filter(
            F.array(F.struct(F.lit("hint").alias("kind"), F.lit(None).cast("string").alias("property"),
                             F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("doc"),
                             F.lit(None).cast("int").alias("page"))),
            lambda _: F.col("engine_version_hint").isNotNull(),
        ),
    ))
    return records.select("cluster", "source", "engine_version_hint", F.explode(items).alias("_i")).select(
        "cluster", "source", "_i.*",
        F.when(F.col("_i.kind") == "hint", F.col("engine_version_hint")).alias("engine_version_hint"),
    )


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages already extracted as text; optional, nothing reads them by default."""
    return passages_from(spark.read.parquet(path))


def passages_from(df: DataFrame) -> DataFrame:
    """Any table with at least ``text`` and ``source_doc`` in the passages schema."""
    optional = {"page": "int", "engine_version": "string"}
    shaped = df.select(
        *[c for c in ("passage_id",) if c in df.columns], "text", "source_doc",
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()],
    )
    if "passage_id" in df.columns:
        return shaped.withColumn("passage_id", F.col("passage_id").cast("string"))
    identity = F.to_json(F.struct("source_doc", "page", "engine_version", "text"))
    return shaped.select(F.sha2(identity, 256).alias("passage_id"), *shaped.columns)
