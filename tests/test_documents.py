"""Query documents as coordinators write them: nested stages, units, repeated captures, fleets."""

import inspect
import json

import pytest
from pyspark.sql import functions as F

from fleet_audit.functions.text import data_bytes, duration_ms
from fleet_audit.operators import report
from fleet_audit.operators.thresholds import default_thresholds, with_overrides
from fleet_audit.sources import stores
from fleet_audit.sources.queries import READ_OFTEN, flat_tables, flatten_query, parse_snapshots, read_query_documents, stage_rows, tables_to_judge
from fleet_audit.streaming import ingest
from tests.test_query_audit import document


@pytest.mark.parametrize("text, ms", [
    ("1.20m", 72000.0), ("15.00ms", 15.0), ("3ns", 3e-6), ("2.5 s", 2500.0), ("1.00d", 86_400_000.0), ("7", 7.0), ("", None), ("soon", None), ("1.2.3s", None), ("4parsec", None), (None, None)])
def test_durations(spark, text, ms):
    assert spark.createDataFrame([(text,)], "t string").select(duration_ms(F.col("t"))).first()[0] == ms


@pytest.mark.parametrize("text, size", [("1.5GB", 1.5 * 2**30), ("10kB", 10240.0), ("0B", 0.0), ("12", 12.0), ("3XB", None), (None, None)])
def test_amounts_of_data(spark, text, size):
    assert spark.createDataFrame([(text,)], "t string").select(data_bytes(F.col("t"))).first()[0] == size


def stage(name, *below, **more):
    return {"stageId": name, "stageStats": {"totalScheduledTime": "1.20m", "processedInputPositions": 3, "operatorSummaries": [{"operatorId": 1, "operatorType": "Join", "spilledDataSize": "1kB"}]},
            "tasks": [{"taskStatus": {"taskId": name + ".0"}, "stats": {"elapsedTime": "2.00s"}}], "subStages": list(below)} | more


def bodies(spark, *documents):
    rows = [("c", f"q{n}", d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(documents)]
    return parse_snapshots(spark.createDataFrame(rows, "cluster string, query_id string, document string"))


def test_stages_at_every_depth(spark):
    deep = stage("a", stage("b", stage("c", stage("d")), stage("e")), stage("f"))
    saved = bodies(spark, {"queryStats": {"elapsedTime": "1.20m", "queuedTime": "3.00s", "peakUserMemoryReservation": "2MB"}, "outputStage": deep}, {"stages": [stage("x"), stage("y", stage("z"))]}, {})
    found = {(r.query_id, r.stage_id): r for r in flatten_query(saved, "stages", placed=True).collect()}
    assert {k[1]: (r.depth, r.parent_stage_id, r.stage_path) for k, r in found.items() if k[0] == "q0"} == {
        "a": (1, None, "0"), "b": (2, "a", "0.0"), "c": (3, "b", "0.0.0"), "d": (4, "c", "0.0.0.0"), "e": (3, "b", "0.0.1"), "f": (2, "a", "0.1")}
    assert found["q1", "z"].parent_stage_id == "y" and {r.wall_ms for r in found.values()} == {72000.0}
    assert flatten_query(saved, "tasks").where("wall_ms = 2000").count() == 9
    assert flatten_query(saved, "operators").where("spilled_bytes = 1024 and operator = 'Join'").count() == 9
    info = {r.query_id: r for r in flatten_query(saved, "query_info").collect()}
    assert (info["q0"].elapsed_ms, info["q0"].queued_ms, info["q0"].peak_memory) == (72000, 3000, 2 << 20) and info["q2"].elapsed_ms is None


def test_odd_stages(spark):
    saved = bodies(spark, {"outputStage": None, "stages": None}, {"outputStage": {"subStages": [{}, 5, None]}}, {"stages": "none"}, "[]", '"text"')
    assert sorted((r.query_id, r.depth) for r in stage_rows(saved).collect()) == [("q1", 1), ("q1", 2), ("q1", 2), ("q1", 2)]
    assert stage_rows(saved.limit(0)).count() == 0
    assert flatten_query(saved, "tasks").count() == 0


def test_documents_are_parsed_once_for_all_tables(spark):
    tables = flat_tables(spark.createDataFrame([("c", "q", json.dumps(document()))], "cluster string, query_id string, document string"))
    for name, df in tables.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "parse_json" not in plan.lower(), name
    assert tables["operators"].count() == 1 and tables["tasks"].count() == 3


def test_stored_captures_count_once_and_fleets_have_their_limits(spark, tmp_path):
    path = str(tmp_path / "store")
    records = [("f1", "c1", "q", 1, json.dumps(document(operator={"spilled_bytes": 5}))), ("f1", "c1", "q", 2, json.dumps(document(operator={"spilled_bytes": 9}))),
               ("f2", "c1", "p", 1, json.dumps(document(operator={"spilled_bytes": 9})))]
    saved = spark.createDataFrame(records, "fleet string, cluster string, query_id string, n long, document string").selectExpr(
        "fleet", "cluster", "query_id", "timestamp_seconds(n) as captured_at", "n as snapshot_id", "document")
    stores.write_snapshots(saved.where("snapshot_id = 1"), path)
    stores.write_snapshots(saved.where("snapshot_id = 2"), path)
    tables = flat_tables(stores.read_snapshots(spark, path))
    own = spark.createDataFrame([("spilling", "f2", "spilled_bytes", 10.0)], "detector string, fleet string, name string, value double")
    found = report.analyze_queries(tables, with_overrides(default_thresholds(spark), own)).where("rule_id = 'spilling'").collect()
    assert [(r.fleet, r.evidence.query_id, r.evidence.value) for r in found] == [("f1", "q", 9.0)]


def test_a_document_may_name_its_fleet(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(document() | {"fleet": "f7"}))
    assert flat_tables(read_query_documents(spark, str(tmp_path)))["query_info"].first().fleet == "f7"


def test_tasks_of_documents_and_of_the_runtime_tables(spark):
    from fleet_audit.sources.queries import merge_tasks

    task = "cluster string, query_id string, stage_id string, task_id string, wall_ms double"
    saved = spark.createDataFrame([("c", "q", "s", "1", 5.0, "f"), ("c", "q", "s", "2", None, "f"), ("c", "q", "s", "2", None, "f"), ("c", "q", "s", "3", 7.0, "f")], task + ", fleet string")
    seen = spark.createDataFrame([("c", "q", "s", "1", 6.0, "n1"), ("c", "q", "s", "2", 9.0, "n2"), ("c", "p", "s", "1", 1.0, None), ("c", "q", "s", "2", 8.0, "n2")], task + ", node string")
    nodes = spark.createDataFrame([("c", "n1", "99"), ("c", "n1", "400"), ("d", "n2", "1")], "cluster string, node string, node_version string")
    found = {(r.query_id, r.task_id): (r.fleet, r.wall_ms, r.node, r.node_version, r.seen_in) for r in merge_tasks(saved, seen, nodes).collect()}
    assert found == {
        ("q", "1"): ("f", 5.0, "n1", "400", "both"), ("q", "2"): ("f", 8.0, "n2", None, "both"),
        ("q", "3"): ("f", 7.0, None, None, "document"), ("p", "1"): (None, 1.0, None, None, "runtime")}
    assert merge_tasks(saved.limit(0), seen.limit(0)).count() == 0


def test_tables_that_detectors_read_often_are_taken_out_of_documents_once(spark):
    body = {"stages": [{"stage_id": "s", "operators": [{"operator_id": "o", "operator": "join", "input_rows": 1}], "tasks": [{"task_id": "t", "wall_ms": 2}]}], "scans": [{"table": "x"}]}
    docs = spark.createDataFrame([("f", "c", "q", json.dumps(body))], "fleet string, cluster string, query_id string, document string")
    judged, flat = tables_to_judge(docs), flat_tables(docs)
    for name in READ_OFTEN:
        assert "variant" not in judged[name]._jdf.queryExecution().optimizedPlan().toString()
        assert judged[name].collect() == flat[name].collect() != []
    assert inspect.signature(ingest.analyze_stream).parameters["tables_of"].default is tables_to_judge
