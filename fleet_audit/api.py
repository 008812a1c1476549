"""Calls about one cluster or one query: each is a filter in front of the fleet-wide job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.findings import all_findings
from fleet_audit.operators import clusters, enrich, redaction, report, rules, scan_estimate, tables
from fleet_audit.operators.audit import cross_checks
from fleet_audit.operators.investigate import Investigation, analyze_with_details
from fleet_audit.operators import search, telemetry, versions
from fleet_audit.operators.normalize import normalize_values, rules_in_scope, scope_filter
from fleet_audit.operators.scope import resolve_scope
from fleet_audit.operators.thresholds import default_thresholds
from fleet_audit.sources.catalog import default_scope_map
from fleet_audit.sources.parsers import parse_all
from fleet_audit.sources.queries import flat_tables


@dataclass
class FleetAudit:
    """The inputs of an audit, and the calls on them. Every call returns DataFrames.

    ``files`` is a configuration backup, ``catalogue`` the rules, ``snapshots`` saved query
    documents, ``references`` the tables ``column_stats`` and ``table_files`` (their
    ``table_id`` is ``cluster.catalog.schema.table``), ``passages`` an optional index of
    recommendation documents; without it, search is off.
    """

    spark: SparkSession
    files: DataFrame | None = None
    catalogue: DataFrame | None = None
    snapshots: DataFrame | None = None
    references: Mapping[str, DataFrame] = field(default_factory=dict)
    passages: DataFrame | None = None
    scope_map: DataFrame | None = None
    thresholds: DataFrame | None = None

    def _files(self, *names: str) -> DataFrame:
        return self.files.where(F.col("cluster").isin(*names)) if names else self.files

    def _entries(self, *names: str) -> DataFrame:
        return normalize_values(parse_all(self._files(*names)))

    def _snapshot(self, *names: str, context: DataFrame | None = None) -> DataFrame:
        return versions.config_snapshot(self._files(*names), self._entries(*names), context)

    def _limits(self) -> DataFrame:
        return default_thresholds(self.spark) if self.thresholds is None else self.thresholds

    # Configuration

    def list_clusters(self) -> DataFrame:
        return clusters.list_clusters(self._snapshot())

    def resolve_scope(self, question: str) -> DataFrame:
        asked = self.spark.createDataFrame([(question,)], "question string")
        return resolve_scope(asked, default_scope_map(self.spark) if self.scope_map is None else self.scope_map)

    def get_config_summary(self, cluster: str, scope: list[str] | None = None) -> DataFrame:
        entries = self._entries(cluster)
        if scope is not None:
            entries = scope_filter(entries, self.catalogue, scope)
        return clusters.config_summary(entries, self._snapshot(cluster))

    def run_rules(
        self, cluster: str, scope: list[str] | None = None, context: DataFrame | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Findings, and the counts of rules evaluated and skipped for the version."""
        entries, snapshot = self._entries(cluster), self._snapshot(cluster, context=context)
        found = all_findings(
            rules.run_rules(entries, self.catalogue, snapshot, scope), *cross_checks(entries, self._files(cluster)))
        counts = versions.rule_run_counts(rules_in_scope(self.catalogue, scope), snapshot)
        return enrich.enrich(found, context, self.passages, snapshot), counts

    def guidance_notes(self, context: DataFrame) -> DataFrame:
        return enrich.annotate_uncovered(context, self.catalogue).unionByName(
            enrich.guidance_conflicts(context, self.catalogue))

    def get_config_detail(self, cluster: str, role: str, file: str) -> DataFrame:
        chosen = self._files(cluster).where((F.col("role") == role) & (F.col("file") == file))
        return redaction.config_detail(chosen, redaction.file_violations(chosen))

    def diff_clusters(self, cluster_a: str, cluster_b: str, scope: list[str] | None = None) -> DataFrame:
        entries = self._entries(cluster_a, cluster_b)
        if scope is not None:
            entries = scope_filter(entries, self.catalogue, scope)
        return clusters.diff_clusters(entries, cluster_a, cluster_b)

    def search_recommendations(self, query: str, engine_version: str | None = None, k: int = 5) -> DataFrame:
        if self.passages is None:
            raise ValueError("no passages were given, so search is off")
        asked = self.spark.createDataFrame(
            [("q", query, engine_version)], "query_id string, query string, engine_version string")
        return search.search_recommendations(self.passages, asked, k).select("rank", "text", "source_doc", "page", "score")

    # Recorded queries

    def _tables(self, cluster: str, query_id: str) -> dict[str, DataFrame]:
        saved = telemetry.query_lookup(self.snapshots, cluster, query_id)
        return flat_tables(saved)

    def get_query_info(self, cluster: str, query_id: str) -> DataFrame:
        return telemetry.query_report(self._tables(cluster, query_id))

    def analyze_query(
        self, cluster: str, query_id: str, context: DataFrame | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Findings, and the row that tells the state and which detectors ran.

        The analysis goes in two stages: what fires on the query's document decides which tables are looked up.
        """
        seen = self.investigate_query(cluster, query_id)
        found = enrich.enrich(seen.findings, context, self.passages)
        return report.rank_findings(found).drop("rank"), seen.coverage

    def investigate_query(self, cluster: str, query_id: str) -> Investigation:
        """Both stages of the analysis with the details they looked up, and why."""
        return analyze_with_details({**self._tables(cluster, query_id), **self.references}, self._limits())

    def get_table_stats(self, cluster: str, catalog: str, schema: str, table: str, measured: DataFrame | None = None) -> DataFrame:
        """Recorded statistics of a table; with its rows as ``measured``, also whether they are stale."""
        name = ".".join((cluster, catalog, schema, table))
        recorded = self.references["column_stats"].where(F.col("table_id") == name)
        if measured is None:
            return recorded.withColumn("stats_stale", F.lit(None).cast("boolean"))
        counted = measured.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_id", F.lit(name))
        stale = tables.stats_stale(recorded.select("table_id", "row_count"), counted, self._limits())
        return recorded.join(stale.select("table_id", "stats_stale"), "table_id")

    def get_partition_info(self, cluster: str, table: str) -> DataFrame:
        """``table`` is ``catalog.schema.table``."""
        return tables.partition_info(self.references["table_files"].where(F.col("table_id") == f"{cluster}.{table}"))

    def estimate_scans(self, scans: DataFrame, scan_columns: DataFrame | None = None) -> DataFrame:
        """Bytes, cost and safety of planned scans (``scan_id, table_id, low, high``) before they run."""
        shares = None if scan_columns is None else scan_estimate.column_share(self.references["column_stats"], scan_columns)
        return scan_estimate.estimate_scan(scans, self.references["table_files"], self._limits(), shares)
