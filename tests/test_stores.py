"""Stores, the shared folder and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare, connect
from fleet_audit import schemas
from fleet_audit.plans import registered
from fleet_audit.sources import stores

SF = "/root/testdata/sf0.001"


def test_shared_folder_is_the_one_the_session_names(spark):
    local = stores.shared_folder(spark)
    assert local != stores.shared_folder(spark)

    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/checkpoints/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert stores.shared_folder(Session()).startswith("hdfs://shared/checkpoints/fleet-audit-")


def test_snapshot_store_appends_and_prunes(spark, tmp_path):
    def rows(n):
        return spark.range(n).select(
            F.concat(F.lit("00"), (F.col("id") % 3).cast("string")).alias("cluster"),
            F.col("id").cast("string").alias("query_id"), F.timestamp_seconds(F.col("id") * 40000).alias("captured_at"),
            F.col("id").alias("snapshot_id"), F.lit("{}").alias("document"))

    stores.write_snapshots(rows(10), str(tmp_path))
    stores.write_snapshots(rows(5), str(tmp_path))
    read = stores.read_snapshots(spark, str(tmp_path))
    assert read.count() == 15
    pruned = read.where("cluster = '001'")
    assert pruned.count() == 5
    assert "PartitionFilters: [isnotnull(cluster" in pruned._jdf.queryExecution().toString()


def test_findings_store_keeps_runs_apart(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.FINDINGS)
    one = spark.createDataFrame([("f", "c", "r", "low", "p", "a", "e", "why", "rule_catalog", None, None)], schemas.FINDINGS)
    stores.write_findings(one, str(tmp_path), "a")
    stores.write_findings(one.union(one), str(tmp_path), "b")
    stores.write_findings(empty, str(tmp_path), "c")
    assert [stores.read_findings(spark, str(tmp_path), r).count() for r in "abc"] == [1, 2, 0]


def test_every_query_has_its_sql():
    assert registered.QUERIES.keys() == registered.ORACLES.keys()
    assert registered.QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["fleet", "cluster", "rule_id"] and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_query_equals_sql(spark, duck, name):
    problems = [p for p in compare(spark, duck, SF, name) if p != "both empty"]
    assert problems == []


def _files(spark, path):
    """Files that a reader of the store opens, by directory."""
    import collections

    rows = stores.read_snapshots(spark, path, placed=True).select("_file", "cluster", "day").distinct().collect()
    return collections.Counter((r["cluster"], r["day"]) for r in rows)


def _captures(spark, first, last):
    return spark.range(first, last).selectExpr(
        "concat('c', id % 3) as cluster", "concat('q', id) as query_id", "timestamp_seconds(id * 3600) as captured_at", "id as snapshot_id", "'{}' as document")


def test_compaction_bounds_the_files_and_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    for k in range(6):
        _captures(spark, 40 * k, 40 * k + 40).withColumn("day", F.to_date("captured_at")).repartition(5).write.mode("append").partitionBy("cluster", "day").parquet(path)
    before = sorted(r.snapshot_id for r in stores.read_snapshots(spark, path).collect())
    assert max(_files(spark, path).values()) > 2
    assert stores.compact_snapshots(spark, path, files_per_directory=2)
    assert sorted(r.snapshot_id for r in stores.read_snapshots(spark, path).collect()) == before == list(range(240))
    assert max(_files(spark, path).values()) <= 2
    stores.write_snapshots(_captures(spark, 240, 300), path)
    assert stores.compact_snapshots(spark, path) and stores.compact_snapshots(spark, path) is None
    assert stores.compact_snapshots(spark, path, everything=True) and max(_files(spark, path).values()) == 1
    assert sorted(r.snapshot_id for r in stores.read_snapshots(spark, path).collect()) == list(range(300))
    assert stores.read_snapshots(spark, path).where("cluster = 'c1'").count() == 100


def test_a_compaction_stopped_midway_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    stores.write_snapshots(_captures(spark, 0, 50), path)

    def stopped(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(type(spark), "createDataFrame", stopped)
        with pytest.raises(KeyboardInterrupt):
            stores.compact_snapshots(spark, path)
    assert stores.read_snapshots(spark, path).count() == 50  # the new files are there, and are not read
    assert stores.compact_snapshots(spark, path)
    assert stores.read_snapshots(spark, path).count() == 50


def test_files_that_arrive_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    stores.write_snapshots(_captures(spark, 0, 50), path)
    stores.compact_snapshots(spark, path)
    stores.write_snapshots(_captures(spark, 50, 60), path)
    listing = stores._live

    def then_more(*args):
        found = listing(*args)
        stores.write_snapshots(_captures(spark, 60, 70), path)
        return found

    with monkeypatch.context() as patched:
        patched.setattr(stores, "_live", then_more)
        stores.compact_snapshots(spark, path, everything=True)
    assert sorted(r.snapshot_id for r in stores.read_snapshots(spark, path).collect()) == list(range(70))


def test_documents_are_fetched_after_the_choice(spark, tmp_path):
    from fleet_audit.operators.telemetry import latest_documents, latest_snapshot

    path = str(tmp_path / "store")
    twice = _captures(spark, 0, 90).selectExpr("cluster", "concat('q', snapshot_id % 7) as query_id", "captured_at", "snapshot_id", "concat('doc', snapshot_id) as document")
    for _ in range(2):
        stores.write_snapshots(twice, path)
    stores.compact_snapshots(spark, path)
    stores.write_snapshots(twice.where("snapshot_id > 80"), path)
    placed = stores.read_snapshots(spark, path, placed=True)
    found = latest_documents(placed)
    assert sorted(map(str, found.collect())) == sorted(map(str, latest_snapshot(stores.read_snapshots(spark, path)).collect()))
    exchanged = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert not any("document" in line for line in exchanged)


def test_captures_of_two_batches_count_once(spark, tmp_path):
    import json

    from fleet_audit import schemas
    from fleet_audit.operators.thresholds import default_thresholds
    from fleet_audit.streaming import ingest
    from tests.test_query_audit import document

    def saved(n, **operator):
        return [(None, "c1", f"q{k}", n, json.dumps(document(operator=operator))) for k in range(3)]

    for name, rows in (("2", saved(5, spilled_bytes=9)), ("1", saved(4, output_rows=5000)[:2]), ("3", saved(6)[:1]), ("4", saved(5, spilled_bytes=9)[1:2])):
        spark.createDataFrame(rows, "fleet string, cluster string, query_id string, n long, document string").selectExpr(
            "fleet", "cluster", "query_id", "timestamp_seconds(n) as captured_at", "n as snapshot_id", "document").coalesce(1).write.json(str(tmp_path / "in" / name))
    for once in range(2):  # the second run has nothing to do
        stream = ingest.snapshot_stream(spark, str(tmp_path / "in" / "*"), schema=schemas.SNAPSHOT_RECORD, files_per_batch=1)
        ingest.analyze_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), default_thresholds(spark)).awaitTermination()
    found = ingest.current_findings(spark, str(tmp_path / "out")).collect()
    assert sorted((r.rule_id, r.evidence.query_id) for r in found) == [("spilling", "q1"), ("spilling", "q2")]
    assert ingest.judged_captures(spark, str(tmp_path / "out")).count() == 3
