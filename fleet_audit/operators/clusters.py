"""Inventory, summary, anomalies and differences of cluster configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleet_audit.functions.nesting import nest_all
from fleet_audit.operators.redaction import shown_value

#: Most properties listed per cluster by default.
SUMMARY_PROPERTIES = 50


def list_clusters(snapshot: DataFrame) -> DataFrame:
    """``name, engine_version, backed_up_at, roles`` of every backed-up cluster."""
    return snapshot.select(
        F.col("cluster").alias("name"), "engine_version", "backed_up_at", "roles"
    )


def summary_properties(entries: DataFrame) -> DataFrame:
    """One row per cluster, role and property: least value, number of values, first file.

    Combined on the map side, so a property set on every node costs little to shuffle.
    """
    return entries.groupBy("cluster", "role", "key").agg(
        F.min(shown_value()).alias("value"),
        F.countDistinct("raw").alias("values"),
        F.min("file").alias("source_file"),
    )


def cap_summary(properties: DataFrame, n: int = SUMMARY_PROPERTIES) -> DataFrame:
    """The first ``n`` properties of each cluster: those with differing values first.

    The limit is applied before the shuffle as well as after it.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("values"), "key", "role")
    return properties.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def config_summary(entries: DataFrame, snapshot: DataFrame, n: int = SUMMARY_PROPERTIES) -> DataFrame:
    """``cluster, part, parts, properties, properties_total, source_files, anomalies, engine_version``.

    Nested form of :func:`summary_properties`, :func:`anomalies` for one row per
    cluster; long lists continue in further parts instead of growing one row. ``properties`` lists the first ``n``
    and ``properties_total`` counts all; ``source_files`` are all files that entries came from, listed or not.
    """
    properties = summary_properties(entries)
    listed = F.struct(F.concat_ws(".", "role", "key").alias("k"), F.col("value").alias("v"))
    kinds = {
        "items": (cap_summary(properties, n), listed),
        "files": (entries.select("cluster", "file").distinct(), F.struct("file")),
        "anomalies": (anomalies(entries), F.struct("kind", "role", "node", "file", "key")),
    }
    totals = properties.groupBy("cluster").agg(F.count(F.lit(1)).alias("properties_total"))
    return (
        nest_all(kinds, ["cluster"])
        .join(snapshot.select("cluster", "engine_version"), "cluster", "left")
        .join(totals, "cluster", "left")
        .select(
            "cluster", "part", "parts",
            F.map_from_entries(F.transform("items", lambda i: F.struct(i.k, i.v))).alias("properties"), "properties_total",
            F.transform("files", lambda i: i.file).alias("source_files"),
            "anomalies", "engine_version",
        )
    )


def anomalies(entries: DataFrame) -> DataFrame:
    """``kind, cluster, role, node, file, key, n``.

    ``repeated_key``: set more than once in one file. ``unparseable``: a value that
    should be a number and is not, judged by the other values of the property in the
    cluster. ``differing_values``: several values among the nodes of one role.
    """
    none = F.lit(None).cast("string")
    repeated = (
        entries.groupBy("cluster", "role", "node", "file", "key").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.lit("repeated_key").alias("kind"), "cluster", "role", "node", "file", "key", "n")
    )
    per_role = entries.groupBy("cluster", "role", "key").agg(
        F.countDistinct("raw").alias("n"),
        F.count_if(F.col("kind") != "text").alias("numbers"),
        F.count_if(F.col("kind") == "text").alias("texts"),
    )
    # Both kinds come from one reading of the entries.
    kind = lambda met, name, n: F.when(F.expr(met), F.struct(F.lit(name).alias("kind"), F.col(n).alias("n")))
    kinds = F.array(kind("n > 1", "differing_values", "n"), kind("texts > 0 and numbers > texts", "unparseable", "texts"))
    odd = per_role.select("cluster", "role", "key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("odd"))
    of_role = odd.select("odd.kind", "cluster", "role", none.alias("node"), none.alias("file"), "key", "odd.n")
    return repeated.unionByName(of_role)


def diff_clusters(entries: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """``property, a, b, role`` where the values of two clusters differ.

    Both clusters are read in one pass and reduced to distinct values with a flag per
    side before they meet, so nothing is joined. ``a`` and ``b`` show the least value
    that only this side has, or the least value when it has no such value.
    """
    chosen = entries.where(F.col("cluster").isin(a, b))
    if keys is not None:
        chosen = chosen.where(F.col("key").isin(keys))
    values = chosen.groupBy("role", "key", shown_value().alias("shown"), "raw").agg(
        F.max(F.col("cluster") == a).alias("in_a"), F.max(F.col("cluster") == b).alias("in_b")
    )

    def pick(own: str, other: str):
        only = F.min(F.when(F.col(own) & ~F.col(other), F.col("shown")))
        return F.coalesce(only, F.min(F.when(F.col(own), F.col("shown"))))

    return (
        values.groupBy("role", "key")
        .agg(
            pick("in_a", "in_b").alias("a"), pick("in_b", "in_a").alias("b"),
            F.max(F.col("in_a") != F.col("in_b")).alias("differ"),
        )
        .where("differ")
        .select(F.col("key").alias("property"), "a", "b", "role")
    )
