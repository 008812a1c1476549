"""Cases at the edges: signs, long versions, refused files, absent statistics, idle stages, open ranges, long lists."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleet_audit import schemas
from fleet_audit.functions.nesting import nest_rows
from fleet_audit.functions.text import limit_parts, normalized
from fleet_audit.functions.versions import gate_array, version_array, version_in_gate
from fleet_audit.operators import redaction, scan_estimate, tables, telemetry
from fleet_audit.operators.detectors import missing_stats, skew
from fleet_audit.operators.median import grouped_median
from fleet_audit.operators.thresholds import default_thresholds, with_thresholds
from fleet_audit.sources import parsers

FILES = "cluster string, role string, node string, file string, content string"


def files_of(spark, **contents):
    return spark.createDataFrame([("c", "coordinator", "n", name.replace("__", "."), text) for name, text in contents.items()], FILES)


@pytest.mark.parametrize("raw, kind, num", [
    ("-1", "number", Decimal(-1)), ("+5", "number", Decimal(5)), ("0.1234567", "number", Decimal("0.123457")), ("-2GB", "size", Decimal(-2 * 2**30)),
    ("1234567890123456789", "number", Decimal(1234567890123456789)), ("9" * 40, "text", None), ("--1", "text", None), ("-", "text", None),
])
def test_signs_and_many_digits(spark, raw, kind, num):
    row = normalized(spark.createDataFrame([(raw,)], "raw string"), F.lit(False)).first()
    assert row.kind == kind and row.num == num


def test_limits_in_texts(spark):
    row = spark.range(1).select(*(c for t in ("<= -1", "at most 0.12345678%") for c in limit_parts(F.lit(t)))).first()
    assert tuple(row) == ("<=", -1.0, None, pytest.approx(0.0012345678))


@pytest.mark.parametrize("version, gate, met", [
    ("413.2.1.9", ">413.2.1.5", True), ("413.2.1.5", ">413.2.1.5", False), ("413", "413.0.0.0", True), ("413.0.0.1", "<=413", False), ("413.2", ">=413.1.9.9", True),
])
def test_all_parts_of_versions(spark, version, gate, met):
    assert spark.range(1).select(version_in_gate(version_array(F.lit(version)), gate_array(F.lit(gate)))).first()[0] is met


def test_files_that_cannot_be_checked_are_refused(spark):
    files = files_of(
        spark, env__sh="export DB_PASSWORD=hunter2", auth__yaml="password: hunter2", **{
            "broken.xml": "<configuration><property><name>a</name>", "good.xml": "<configuration><property><name>a</name><value>b</value></property></configuration>",
            "number.json": '{"password": 12345}', "later.json": '{"password":\n   "hunter2"}', "broken.json": '{"a": ', "good.json": '{"a": 1, "password": "***"}',
            "config.properties": "# path C:\\\ndb.password=hunter2\n", "good.properties": "a=b\n", "jvm.config": "-Xmx1G\n"})
    detail = redaction.config_detail(files, redaction.file_violations(files)).collect()
    assert {r.file for r in detail} == {"good.xml", "good.json", "good.properties", "jvm.config"} and all(r.redaction_verified for r in detail)
    refused = redaction.refusal_findings(redaction.unverifiable(files)).collect()
    assert {r.property for r in refused} == {"env.sh", "auth.yaml", "broken.xml", "broken.json"} and {r.severity for r in refused} == {"high"}
    assert not any("hunter2" in str(r) for r in refused)


def test_continued_lines_and_comments(spark):
    text = "# path C:\\\na=1\nb=x\\\n  y\nc=even\\\\\nd=4\n"
    got = {(r.key, r.raw, r.line) for r in parsers.properties_entries(files_of(spark, config__properties=text)).collect()}
    assert got == {("a", "1", 2), ("b", "xy", 3), ("c", "even\\\\", 5), ("d", "4", 6)}


def test_lines_of_repeated_names_and_policies(spark):
    xml = "<configuration>\n<property><name>a</name><value>1</value></property>\n<property><name>a</name><value>2</value></property>\n</configuration>"
    assert sorted((r.raw, r.line) for r in parsers.hive_site_entries(files_of(spark, **{"hive-site.xml": xml})).collect()) == [("1", 2), ("2", 3)]
    policies = '{"policies": [\n{"id": 12, "name": "x"},\n{"id":1, "name": "y"}]}'
    got = {(r.key, r.line) for r in parsers.ranger_entries(files_of(spark, **{"policies.json": policies})).collect() if r.key.endswith(".name")}
    assert got == {("policy.12.name", 2), ("policy.1.name", 3)}


def test_a_table_without_any_statistics(spark):
    scans = spark.createDataFrame([("f", "c", "q", "t")], "fleet string, cluster string, query_id string, table_id string")
    stats = spark.createDataFrame([], "table_id string, column_name string, ndv bigint, row_count bigint")
    found = missing_stats.detect({"scans": scans, "column_stats": stats}, default_thresholds(spark)).collect()
    assert [(r.evidence.table, r.actual) for r in found] == [("t", "no row count, 0 columns without NDV")]


def test_one_long_task_among_idle_ones(spark):
    rows = [("f", "c", "q", "s", float(w)) for w in [0] * 8 + [3_600_000]] + [("f", "c", "q", "idle", 0.0), ("f", "c", "q", "short", 0.0), ("f", "c", "q", "short", 0.0), ("f", "c", "q", "short", 20.0)]
    tasks = spark.createDataFrame(rows, "fleet string, cluster string, query_id string, stage_id string, wall_ms double")
    assert [r.evidence.stage_id for r in skew.detect({"tasks": tasks}, default_thresholds(spark)).collect()] == ["s"]


@pytest.mark.parametrize("rows_per_task", [2, 1000])
def test_medians_leave_out_what_has_no_order(spark, rows_per_task):
    values = [("g", v) for v in (1.0, 2.0, 9.0, float("nan"), float("inf"), None)]
    row = grouped_median(spark.createDataFrame(values, "k string, v double"), ["k"], "v", rows_per_task).first()
    assert (row["rows"], row["max_value"], row["median"]) == (3, 9.0, 2.0)


def test_open_ranges_and_one_sided_tables(spark):
    scans = spark.createDataFrame([("a", "t", None, None), ("b", "t", 2, None), ("c", "t", None, 1)], "scan_id string, table_id string, low bigint, high bigint")
    listing = spark.createDataFrame([("t", k, 10 * k) for k in (1, 2, 3)], "table_id string, part bigint, bytes bigint")
    got = {r.scan_id: (r.partitions, r.estimated_scan_bytes) for r in scan_estimate.estimate_scan(scans, listing, default_thresholds(spark)).collect()}
    assert got == {"a": (3, 60), "b": (2, 50), "c": (1, 10)}
    sides = [spark.createDataFrame([(t, 5)], "table_id string, row_count bigint") for t in ("only recorded", "only measured")]
    assert {r.table_id: r.stats_stale for r in tables.stats_stale(*sides, default_thresholds(spark)).collect()} == {"only recorded": True, "only measured": True}


@pytest.mark.parametrize("limit", [0, 1000])
def test_thresholds_without_a_value(spark, limit):
    from fleet_audit.operators.thresholds import Thresholds

    rows = spark.createDataFrame([("d", None, "n", 1.0), ("d", "f", "n", None), ("d", "g", "n", 2.0)], schemas.THRESHOLDS)
    df = spark.createDataFrame([("f",), ("g",), (None,)], "fleet string")
    got = {r.fleet: r.threshold for r in with_thresholds(df, Thresholds.of(rows, limit), "d", "n").collect()}
    assert got == {"f": 1.0, "g": 2.0, None: 1.0}


def test_long_lists_continue_in_order(spark):
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("v"))
    rows = sorted(nest_rows(df, ["k"], F.col("v"), "vs", rows_per_part=150).collect(), key=lambda r: r.part)
    assert [v for r in rows for v in r.vs] == [7] * 1000 + list(range(1000, 2000)) and {len(r.vs) for r in rows[:-1]} == {150}


def test_the_last_capture_counts(spark):
    rows = [("c", "q", 1, "a"), ("c", "q", 2, "b")]
    df = spark.createDataFrame(rows, "cluster string, query_id string, captured_at int, document string")
    assert [r.document for r in telemetry.latest_snapshot(df).collect()] == ["b"]


def test_text_partitions(spark):
    from fleet_audit.operators.detectors import no_partition_pruning
    from fleet_audit.sources.metadata import combine_listings

    days = spark.createDataFrame([("t", f"2024-01-0{d}", "ORC", 10) for d in range(1, 5)], "table_id string, part string, format string, bytes bigint")
    listing = combine_listings(days, days.limit(0))
    assert {r.part for r in listing.collect()} == {f"2024-01-0{d}" for d in range(1, 5)}
    scans = spark.createDataFrame(
        [("f", "c", "q", "t", f"2024-01-0{d}", "ds", None) for d in range(1, 5)],
        "fleet string, cluster string, query_id string, table_id string, part string, partition_column string, predicate string")
    found = no_partition_pruning.detect({"scans": scans, "table_files": listing}, default_thresholds(spark)).collect()
    assert [r.actual for r in found] == ["4 of 4"]
    asked = spark.createDataFrame([("a", "t", None, None)], "scan_id string, table_id string, low bigint, high bigint")
    assert not scan_estimate.estimate_scan(asked, listing, default_thresholds(spark)).first().safe_to_run


@pytest.mark.parametrize("check, met", [
    ("text <= 16", [True, None]), ("16 >= text", [True, None]), ("value = 'production'", [False, None]), ("text = 'production'", [False, True]), ("value <= 16 and text <> 'x'", [True, None]),
])
def test_checks_of_mixed_types_do_not_fail(spark, check, met):
    from fleet_audit.functions.checks import typed_check

    rows = spark.createDataFrame([(Decimal(8), "8"), (None, "production")], "value decimal(38,6), text string")
    assert [r[0] for r in rows.select(F.expr(typed_check(check))).collect()] == met


def test_versions_and_gates_are_split_once():
    assert str(version_array(F.col("v"))).count("split(") == 1
    assert str(version_in_gate(version_array(F.col("v")), F.col("g"))).count("split(") == 1
