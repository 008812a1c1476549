"""Configuration backups: one directory per cluster and role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit import fixed_values

_ROLES = "|".join(fixed_values.BACKUP_ROLES)
_LAYOUT = rf"/configs/(?:cluster=)?([^/]+)/(?:role=)?({_ROLES})/(.+)$"


def read_config_backup(spark: SparkSession, root: str, nodes_in_path: bool = False) -> DataFrame:
    """Every file below ``<root>/configs/<cluster>/<role>/`` as one row (``config_files``).

    ``root`` is any path Spark can read, local or object store; executors read in
    parallel and nothing is listed on the driver beyond Spark's own file index.
    Directories may also be named ``cluster=<cluster>/role=<role>``. The layout has no
    node level, so ``node`` is the role; with ``nodes_in_path`` the first directory below
    the role names the node.
    """
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .load(root.rstrip("/") + "/configs")
        .select(
            F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")).alias("path"),
            F.col("value").alias("content"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )
    part = {name: F.regexp_extract("path", _LAYOUT, i) for i, name in enumerate(("cluster", "role", "below"), 1)}
    named = files.select(
        part["cluster"].alias("cluster"), part["role"].alias("role"), part["below"].alias("below"),
        "content", "modified_at",
    ).where("role <> ''")
    if nodes_in_path:
        node, file = F.split_part("below", F.lit("/"), F.lit(1)), F.regexp_replace("below", r"^[^/]+/", "")
    else:
        node, file = F.col("role"), F.col("below")
    return named.select("cluster", "role", node.alias("node"), file.alias("file"), "content", "modified_at")
