"""The calls about one cluster or one query."""

import json

import pytest

from fleet_audit.api import FleetAudit
from tests.test_query_audit import document, scan


@pytest.fixture(scope="module")
def audit(spark, files, rules):
    documents = [
        ("c1", "a", 1, json.dumps(document())),
        ("c1", "a", 2, json.dumps(document(queued_ms=900, operator={"spilled_bytes": 5}, scans=scan("c1.h.s.t")))),
        ("c2", "a", 1, json.dumps(document(tasks=[1, 1, 100]))),
    ]
    snapshots = spark.createDataFrame(documents, "cluster string, query_id string, n long, document string").selectExpr(
        "cluster", "query_id", "timestamp_seconds(n) as captured_at", "n as snapshot_id", "document")
    references = {
        "column_stats": spark.createDataFrame(
            [("c1.h.s.t", "a", 3, 0, 24, 10), ("c1.h.s.t", "b", None, 0, 8, 10), ("c2.h.s.t", "a", 1, 0, 8, 1)],
            "table_id string, column_name string, ndv bigint, nulls bigint, size bigint, row_count bigint"),
        "table_files": spark.createDataFrame(
            [("c1.h.s.t", 1, "f1", "ORC", 10), ("c1.h.s.t", 2, "f2", "ORC", 30)],
            "table_id string, part bigint, path string, format string, bytes bigint"),
    }
    passages = spark.createDataFrame(
        [("p1", "heap and memory limits", "Guide", 1, None), ("p2", "something else", "Guide", 2, None)],
        "passage_id string, text string, source_doc string, page int, engine_version string")
    return FleetAudit(spark, files, rules, snapshots, references, passages)


def test_config_calls(audit, context):
    assert {r.name for r in audit.list_clusters().collect()} == {"c1", "c2"}
    assert audit.resolve_scope("OOM all day").first().scopes == ["jvm", "memory", "spill"]
    summary = audit.get_config_summary("c1", ["memory"]).first()
    assert set(summary.properties) == {"coordinator.query.max-memory-per-node", "worker.query.max-memory-per-node",
                                       "coordinator.query.max-memory"}
    found, counts = audit.run_rules("c1", ["memory"], context)
    assert sorted(r.rule_id for r in found.collect()) == [
        "MEM-002", "catalog_hms_mismatch", "environment_drift", "heap_mismatch"]
    assert counts.first()[1:] == (1, 1)
    assert audit.guidance_notes(context).count() == 3
    assert audit.get_config_detail("c1", "coordinator", "jvm.config").first().redaction_verified
    assert audit.get_config_detail("c2", "coordinator", "config.properties").count() == 0
    assert {r.property for r in audit.diff_clusters("c1", "c2", ["memory"]).collect()} == {
        "query.max-memory", "query.max-memory-per-node"}


def test_search_is_off_without_passages(audit, spark):
    assert audit.search_recommendations("memory").first().text == "heap and memory limits"
    with pytest.raises(ValueError):
        FleetAudit(spark).search_recommendations("memory")


def test_query_calls(audit):
    info = audit.get_query_info("c1", "a").collect()
    assert len(info) == 1 and info[0].queued_ms == 900
    found, coverage = audit.analyze_query("c1", "a")
    assert [r.rule_id for r in found.collect()] == ["not_the_querys_fault", "missing_stats", "spilling"]
    assert len(coverage.first().detectors_run) == 9
    assert [r.rule_id for r in audit.analyze_query("c2", "a")[0].collect()] == ["missing_stats", "skew"]  # its table has no statistics at all


def test_table_calls(audit, spark):
    stats = audit.get_table_stats("c1", "h", "s", "t", spark.range(20)).collect()
    assert len(stats) == 2 and all(r.stats_stale for r in stats)
    assert audit.get_table_stats("c1", "h", "s", "t").first().stats_stale is None
    layout = audit.get_partition_info("c1", "h.s.t").first()
    assert (layout.partition_count, layout.files, layout.avg_file_bytes) == (2, 2, 20.0)
    scans = spark.createDataFrame([("x", "c1.h.s.t", 2, 9)], "scan_id string, table_id string, low bigint, high bigint")
    columns = spark.createDataFrame([("x", "c1.h.s.t", "b")], "scan_id string, table_id string, column_name string")
    row = audit.estimate_scans(scans, columns).first()
    assert (row.estimated_scan_bytes, row.estimated_cost, row.safe_to_run) == (30, 7.5, True)
