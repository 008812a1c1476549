"""The registered query of :mod:`fleet_audit.llm.projected_search`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.projected_search import nearest_vectors
from fleet_audit.llm.shared import table


def op1_projected_kdtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)
