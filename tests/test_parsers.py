"""Files of a backup become entries with the right key, value, number and line."""

from decimal import Decimal

import pytest

from fleet_audit.operators.normalize import normalize_values
from fleet_audit.sources.parsers import assignment_entries

FILE = "c1/coordinator/config.properties"


def lookup(entries, cluster, role, file, key):
    rows = entries.where(
        (entries.cluster == cluster) & (entries.role == role) & (entries.file == file) & (entries.key == key)
    ).orderBy("line").collect()
    return [(r.line, r.raw, r.kind, r.num, r.unit) for r in rows]


def test_every_file_is_read_with_cluster_role_and_name(files):
    seen = {(r.cluster, r.role, r.file) for r in files.select("cluster", "role", "file").collect()}
    assert ("c1", "coordinator", "catalog/hive.properties") in seen
    assert ("c1", "hms", "hive-site.xml") in seen and ("c1", "ranger", "policies.json") in seen
    assert ("c2", "coordinator", "jvm.config") in seen and len(seen) == 12


@pytest.mark.parametrize("key, expected", [
    ("query.max-memory-per-node", [(27, "40GB", "size", Decimal(40 * 2**30), "bytes")]),
    ("http-server.http.port", [(5, "8080", "number", Decimal(8080), None)]),
    ("node-scheduler.include-coordinator", [(4, "false", "boolean", Decimal(0), None)]),
    ("task.concurrency", [(9, "16", "number", Decimal(16), None), (10, "32", "number", Decimal(32), None)]),
    ("query.min-expire-age", [(14, "15m", "duration", Decimal(900_000), "ms")]),
    ("query.client.timeout", [(22, "5.5m", "duration", Decimal(330_000), "ms")]),
    ("memory.heap-headroom-per-node", [(19, "20%", "percent", Decimal("0.2"), "share")]),
    ("event-listener.config-files", [(15, "a.properties,b.properties", "text", None, None)]),
    ("spill-enabled", [(17, "false", "boolean", Decimal(0), None)]),
])
def test_properties(entries, key, expected):
    assert lookup(entries, "c1", "coordinator", "config.properties", key) == expected


def test_comments_are_no_entries(entries):
    assert entries.where("key like '%comment%' or key like '#%' or key like '!%'").count() == 0


def test_jvm(entries):
    get = lambda key: lookup(entries, "c1", "coordinator", "jvm.config", key)
    assert get("-Xmx") == [(2, "80G", "size", Decimal(80 * 2**30), "bytes")]
    assert get("UseG1GC")[0][:2] == (3, "true") and get("UseBiasedLocking")[0][:2] == (4, "false")
    assert get("G1HeapRegionSize")[0][3] == Decimal(32 * 2**20)
    assert get("jdk.attach")[0][:2] == (6, "true")


def test_xml(entries):
    assert lookup(entries, "c1", "hms", "hive-site.xml", "hive.metastore.uris")[0][:2] == (
        4, "thrift://hms-1:9083,thrift://hms-2:9083")
    assert lookup(entries, "c1", "hms", "hive-site.xml", "javax.jdo.option.ConnectionPassword")[0][0] == 8


def test_policies(entries):
    get = lambda key: lookup(entries, "c1", "ranger", "policies.json", key)[0][:2]
    assert get("policy.1.name") == (4, "all databases") and get("policy.2.isEnabled") == (5, "false")
    assert get("policy.2.users") == (5, '["ann","bob"]')


def test_assignments_are_found_in_nested_json(spark):
    files = spark.createDataFrame(
        [("c", "ranger", "ranger", "x.json", '{"a": {\n "adminPassword": "hunter2", "n": 1}}')],
        "cluster string, role string, node string, file string, content string")
    assert [(r.line, r.key, r.raw) for r in assignment_entries(files).collect()] == [(2, "adminPassword", "hunter2")]


@pytest.mark.parametrize("raw, kind, num", [
    ("1kB", "size", 1024), ("2 MB", "size", 2 * 2**20), ("3TB", "size", 3 * 2**40), ("7B", "size", 7),
    ("100ms", "duration", 100), ("2d", "duration", 172_800_000), ("TRUE", "boolean", 1), ("12", "number", 12),
    ("lots", "text", None), ("", "text", None), ("5XB", "text", None), ("9" * 40, "text", None), ("9" * 20, "number", int("9" * 20)), ("-5", "number", -5),
])
def test_normalized_values(spark, raw, kind, num):
    row = normalize_values(spark.createDataFrame([("config.properties", raw)], "file string, raw string")).first()
    assert (row.kind, None if row.num is None else int(row.num)) == (kind, num)
