"""Checks across files and nodes that no single-property rule can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import to_findings
from fleet_audit.functions.text import human_bytes
from fleet_audit.sources.parsers import JVM_FILES


def heap_ranges(entries: DataFrame) -> DataFrame:
    """Least and largest heap of coordinators and of workers, one row per cluster."""
    heaps = entries.where(
        F.col("file").rlike(JVM_FILES) & F.expr("key = '-Xmx' and num is not null and role in ('coordinator', 'worker')")
    )
    aggregates = [
        agg(F.when(F.col("role") == role, F.col("num"))).alias(f"{role}_{name}")
        for role in ("coordinator", "worker")
        for name, agg in (("least", F.min), ("most", F.max))
    ]
    return heaps.groupBy("cluster").agg(*aggregates)


def check_heap_mismatch(entries: DataFrame) -> DataFrame:
    """Coordinators and workers of a cluster do not all have the same heap.

    One pass with conditional aggregates; the two sides are never joined.
    """
    ranges = heap_ranges(entries).where("coordinator_least is not null and worker_least is not null")
    mismatch = ranges.where(
        "least(coordinator_least, worker_least) <> greatest(coordinator_most, worker_most)"
    )

    def span(role: str) -> Column:
        low, high = F.col(f"{role}_least"), F.col(f"{role}_most")
        return F.when(low == high, human_bytes(low)).otherwise(
            F.concat(human_bytes(low), F.lit(" to "), human_bytes(high))
        )

    return to_findings(
        mismatch,
        cluster=F.col("cluster"), rule_id="heap_mismatch", severity="medium", property="-Xmx",
        actual=F.concat(F.lit("coordinator "), span("coordinator"), F.lit(", worker "), span("worker")),
        expected="one heap size", rationale="Memory limits are set once for the cluster and assume equal heaps.",
        metric="heap_bytes", value=F.col("worker_most").cast("double"),
        threshold=F.col("coordinator_most").cast("double"), cause="coordinator_worker_mismatch",
    )


def _addresses(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per address of entries that list metastore addresses."""
    one = F.explode(F.split(F.lower(F.trim("raw")), r"\s*,\s*")).alias("uri")
    return entries.where(F.col("key").isin(keys)).select("cluster", "role", "node", "file", "line", one).withColumn(
        "uri", F.regexp_replace("uri", r"/+$", "")
    ).where("uri <> ''")


def check_catalog_hms(
    entries: DataFrame,
    catalog_keys: tuple[str, ...] = ("hive.metastore.uri",),
    hms_keys: tuple[str, ...] = ("hive.metastore.uris",),
) -> DataFrame:
    """A catalog points at a metastore that the cluster's metastore files do not name.

    Clusters without metastore files cannot be judged and give nothing. Catalog entries
    are matched by address (anti join), never paired with all addresses of the cluster.
    """
    catalog = _addresses(entries.where("role in ('coordinator', 'worker')"), list(catalog_keys))
    known = _addresses(entries.where("role = 'hms'"), list(hms_keys)).select("cluster", "uri").distinct()
    expected = known.groupBy("cluster").agg(F.min("uri").alias("hms_uri"), F.count("uri").alias("uris"))
    wrong = catalog.join(known, ["cluster", "uri"], "left_anti").join(expected, "cluster")
    more = F.when(F.col("uris") > 1, F.concat(F.lit(" and "), (F.col("uris") - 1).cast("string"), F.lit(" more")))
    return to_findings(
        wrong,
        cluster=F.col("cluster"), rule_id="catalog_hms_mismatch", severity="high",
        property=F.lit(catalog_keys[0]), actual=F.col("uri"),
        expected=F.concat(F.col("hms_uri"), F.coalesce(more, F.lit(""))),
        rationale="The catalog reads table metadata from a metastore that is not this cluster's own.",
        file=F.concat_ws("/", "role", "file"), line=F.col("line"), cause=F.col("node"),
    )


def _usual(values: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent value per key (ties: the least), and how many values there are."""
    counted = values.groupBy(*keys, "raw").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct((-F.col("n")).alias("n"), F.col("raw").alias("raw"))
    return counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("kinds"), F.min_by("raw", first).alias("usual")
    )


def check_environment_drift(entries: DataFrame, key: str = "node.environment") -> DataFrame:
    """Nodes whose environment name differs from the usual one of their cluster."""
    values = entries.where(F.col("key") == key)
    usual = _usual(values, ["cluster"]).where("kinds > 1")
    outliers = values.join(usual, "cluster").where("raw <> usual")
    return to_findings(
        outliers,
        cluster=F.col("cluster"), rule_id="environment_drift", severity="medium", property=F.lit(key),
        actual=F.col("raw"), expected=F.col("usual"),
        rationale="Nodes with another environment name do not join the cluster.",
        file=F.concat_ws("/", "role", "file"), line=F.col("line"), cause=F.col("node"),
    )


def check_fleet_drift(entries: DataFrame, key: str = "node.environment") -> DataFrame:
    """Clusters whose usual environment name differs from the usual one of the fleet."""
    per_cluster = _usual(entries.where(F.col("key") == key), ["cluster"]).select(
        "cluster", F.col("usual").alias("raw")
    )
    fleet = _usual(per_cluster.withColumn("_all", F.lit(1)), ["_all"]).agg(F.max("usual")).scalar()
    return to_findings(
        per_cluster.withColumn("usual", fleet).where("raw <> usual"),
        cluster=F.col("cluster"), rule_id="fleet_environment_drift", severity="low", property=F.lit(key),
        actual=F.col("raw"), expected=F.col("usual"),
        rationale="The cluster's environment name is unlike that of the rest of the fleet.",
    )
