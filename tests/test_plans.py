"""Shapes of physical plans, and hot keys on the operators that group or rank."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleet_audit.operators import audit, clusters, telemetry
from fleet_audit.operators.enrich import best_rationale
from fleet_audit.plans import registered, standins
from fleet_audit.sources.queries import flatten_query, parse_snapshots

SF = "/root/testdata/sf0.001"
#: These write files, so only their last step would be seen.
READ_BACK = {"ingest_snapshots_stream", "analyze_stream", "write_snapshots", "write_findings"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registered.QUERIES if n not in READ_BACK and not n.startswith("table_stats_")])
def test_no_pairs_of_all_rows(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "PythonUDF" not in text


def test_scans_read_only_what_is_used(spark):
    text = entry.queries()["detect_spilling"](spark, SF)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert {c.split(":")[0] for s in schemas for c in s.split(",")} == {"l_orderkey", "l_extendedprice", "l_discount"}


def test_filters_reach_the_scan(spark):
    text = telemetry.query_lookup(standins.table(spark, SF, "events").selectExpr(
        "event_type as cluster", "props as query_id", "value"), "click", "x")._jdf.queryExecution().toString()
    assert "EqualTo(event_type,click)" in text and "EqualTo(props,x)" in text


def test_parsing_does_not_shuffle(spark):
    for name in ("properties_entries", "normalize_values", "sensitive_keys", "resolve_scope", "with_thresholds"):
        assert "Exchange" not in plan(entry.queries()[name](spark, SF)), name
    docs = standins.event_snapshots(spark, SF)
    assert "Exchange" not in plan(flatten_query(parse_snapshots(docs), "operators"))


def hot(spark, n=60_000):
    """A third of all rows share one key."""
    return spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))


@pytest.mark.parametrize("build", [
    lambda df: telemetry.latest_snapshot(df.selectExpr(
        "'c' as cluster", "k as query_id", "timestamp_seconds(id) as captured_at", "id as snapshot_id")),
    lambda df: best_rationale(df.selectExpr("k", "id as priority", "'t' as text"), ["k"]),
    lambda df: clusters.cap_summary(df.selectExpr("k as cluster", "'r' as role", "cast(id as string) as key", "id as values"), 3),
])
def test_ranking_limits_a_hot_key_before_the_shuffle(spark, build):
    df = build(hot(spark).repartition(8))
    text = plan(df)
    assert re.search(r"WindowGroupLimit .*Partial", text) and re.search(r"WindowGroupLimit .*Final", text)
    assert df.count() >= 40_001


def test_coverage_reads_the_scans_once_and_medians_are_sorted(spark):
    from fleet_audit.operators import median, report

    tables = standins.telemetry(spark, SF)
    text = plan(report.detector_coverage(tables))
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem", text)) == 5  # operators, tasks, scans, files of scans, and the tables that are listed
    assert "ObjectHashAggregate" not in plan(median.grouped_median(tables["tasks"], ["cluster", "query_id", "stage_id"], "wall_ms"))


def test_an_audit_parses_files_once(spark):
    files = standins.config_files(spark, SF)
    once = audit.audit_config(files, standins.rules(spark))
    # Of the files' own text only assignments and JSON are read again, and no text is joined at backslashes for it.
    assert "_text" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan(entry.queries()["context_independence"](spark, SF))
