"""The two-stage analysis: what is looked up, what is not, and what comes of it."""

import json

import pytest
from pyspark.sql import functions as F

from fleet_audit.operators import investigate, report
from fleet_audit.operators.thresholds import default_thresholds
from fleet_audit.sources.queries import flat_tables
from tests.test_query_audit import FIRING, MB, document, scan

COLUMNS = "cluster string, query_id string, document string"


@pytest.fixture(scope="module")
def references(spark):
    return {
        "table_files": spark.createDataFrame([("p", i, 1) for i in range(10)] + [("t", 0, 1)], "table_id string, part bigint, bytes bigint"),
        "column_stats": spark.createDataFrame([("no_stats", "a", None, 10), ("t", "a", 3, 10), ("p", "a", 3, 10)], "table_id string, column_name string, ndv bigint, row_count bigint"),
    }


def flat(spark, documents, references):
    rows = [("c1", name, json.dumps(d)) for name, d in documents.items()]
    return {**flat_tables(spark.createDataFrame(rows, COLUMNS)), **references}


def fired(findings):
    return {(r.rule_id, r.evidence.query_id) for r in findings.collect()}


def test_details_are_read_for_what_fired_only(spark, references):
    documents = {f"{n}{s}": d for n, pair in FIRING.items() for s, d in zip("+-", pair)}
    documents["both"] = document(operator={"spilled_bytes": 1}, scans=scan("no_stats"))
    tables = flat(spark, documents, references)
    seen = investigate.analyze_with_details(tables, default_thresholds(spark))
    every = fired(report.analyze_queries(tables, default_thresholds(spark)))
    # Nothing in the document of "missing_stats+" gives a reason to look up its table.
    assert fired(seen.findings) == every - {("missing_stats", "missing_stats+")}
    because = {(r.query_id, r.detail): r.because for r in seen.followed.collect()}
    assert because["skew+", "tasks"] == because["skew+", "column_stats"] == "skew"
    assert because["both", "table_files"] == because["both", "column_stats"] == "spilling"
    assert because["no_partition_pruning-", "table_files"] == "wrapped_predicate"
    assert not any(q in ("not_the_querys_fault+", "missing_stats+", "skew-") for q, _ in because)
    assert {r.stage_id for r in seen.details["tasks"].collect()} == {"s1"} and seen.details["tasks"].count() == 4
    assert {r.table_id for r in seen.details["column_stats"].collect()} == {"t", "no_stats"}
    ran = {r.query_id: set(r.detectors_run) for r in seen.coverage.collect()}
    assert "missing_stats" in ran["both"] and "missing_stats" not in ran["missing_stats+"]
    assert "no_partition_pruning" in ran["no_partition_pruning-"] and "no_partition_pruning" not in ran["not_the_querys_fault+"]


def test_nothing_fired_reads_no_detail(spark, references):
    seen = investigate.analyze_with_details(flat(spark, {"calm": document()}, references), default_thresholds(spark))
    assert seen.findings.count() == seen.followed.count() == 0
    assert all(d.count() == 0 for d in seen.details.values())
    for name in ("column_stats", "table_files", "tasks"):
        assert "Join" not in seen.details[name]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit, kind", [(100_000, "Broadcast"), (0, "SortMergeJoin|ShuffledHashJoin")])
def test_every_detail_is_semi_joined(spark, references, monkeypatch, limit, kind):
    import re

    from fleet_audit.functions import bounds

    monkeypatch.setattr(bounds.broadcast_if_small, "__defaults__", (limit,))
    tables = flat(spark, {"both": document(operator={"spilled_bytes": 1}, scans=scan("no_stats"), tasks=[10, 10, 99])}, references)
    wide = {k: v.repartition(3) if k in ("column_stats", "table_files") else v for k, v in tables.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = investigate.analyze_with_details(wide, default_thresholds(spark))
        for name in ("column_stats", "table_files", "tasks"):
            plan = seen.details[name]._jdf.queryExecution().executedPlan().toString()
            assert "LeftSemi" in plan and re.search(kind, plan), name
        assert fired(seen.findings) == {("spilling", "both"), ("skew", "both"), ("missing_stats", "both")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_of_one_name_in_two_clusters_stay_apart(spark):
    documents = {"a": document(operator={"spilled_bytes": 1}, scans=scan("t", range(9), "year(ds) = 1"))}
    rows = [(c, q, json.dumps(d)) for q, d in documents.items() for c in ("c1", "c2")]
    tables = {
        **flat_tables(spark.createDataFrame(rows, COLUMNS)),
        "table_files": spark.createDataFrame([("c1", "t", i, 64 * MB) for i in range(9)] + [("c2", "t", i, 1) for i in range(40)], "cluster string, table_id string, part bigint, bytes bigint"),
        "column_stats": spark.createDataFrame([("c1", "t", "a", 5, 9), ("c2", "t", "a", None, 9)], "cluster string, table_id string, column_name string, ndv bigint, row_count bigint"),
    }
    want = {("no_partition_pruning", "c1"), ("missing_stats", "c2"), ("spilling", "c1"), ("spilling", "c2")}
    for found in (report.analyze_queries(tables, default_thresholds(spark)), investigate.analyze_with_details(tables, default_thresholds(spark)).findings):
        assert {(r.rule_id, r.cluster) for r in found.collect()} == want


def test_without_references_or_queries(spark, references):
    tables = flat(spark, {"both": document(operator={"spilled_bytes": 1})}, {})
    seen = investigate.analyze_with_details(tables, default_thresholds(spark))
    assert fired(seen.findings) == {("spilling", "both")} and seen.followed.count() == 0
    empty = {k: v.limit(0) for k, v in {**tables, **references}.items()}
    assert investigate.analyze_with_details(empty, default_thresholds(spark)).findings.count() == 0
    with pytest.raises(ValueError):
        investigate.analyze_with_details(references, default_thresholds(spark))
    assert tables["scans"].where(F.lit(True)).count() == 1
