"""Documents are made with one exchange, parsed once, and chosen without being exchanged."""

import glob
import os

from pyspark.sql import functions as F

from fleet_audit.operators.clusters import anomalies
from fleet_audit.operators.telemetry import latest_documents
from fleet_audit.plans import registered, standins
from fleet_audit.sources import queries, stores
from fleet_audit.sources.stores import materialize

SF = "/root/testdata/sf0.001"


def _plan(df, optimized=False):
    execution = df._jdf.queryExecution()
    return (execution.optimizedPlan() if optimized else execution.executedPlan()).toString()


def test_documents_take_one_exchange_and_one_parse(spark):
    documents = standins.documents_of_queries(spark, SF)
    assert _plan(documents).count("Exchange ") == 1
    assert _plan(queries.parse_snapshots(documents), optimized=True).count("parseJson") == 1


def test_written_documents_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "shared_folder", lambda _: f"{tmp_path}/landing")
    registered.QUERIES["read_query_snapshots"](spark, SF)
    files = [f for f in glob.glob(f"{tmp_path}/**/*.json*", recursive=True) if os.path.basename(f).startswith("part-")]
    text = standins.documents_of_queries(spark, SF).agg(F.sum(F.length("document"))).first()[0]
    assert sum(map(os.path.getsize, files)) < text / 4


def test_chosen_documents_are_not_exchanged(spark):
    """Two captures of 50,000 queries in one file, more rows than a bitmap holds."""
    rows = spark.range(100_000).select(
        F.lit("c").alias("cluster"), F.concat(F.lit("q"), F.col("id") % 50_000).alias("query_id"), F.col("id").alias("captured_at"),
        F.concat(F.lit("d"), F.col("id")).alias("document"))
    stored = materialize(rows.coalesce(1), placed=True)
    last = latest_documents(stored)
    assert last.columns == rows.columns
    found = last.agg(F.count(F.lit(1)), F.min("captured_at"), F.countDistinct("query_id"), F.sum((F.col("document") != F.concat(F.lit("d"), "captured_at")).cast("int"))).first()
    assert tuple(found) == (100_000 - 50_000, 50_000, 50_000, 0)
    exchanged = [line for line in _plan(last).splitlines() if "Exchange hashpartitioning" in line or "SortMergeJoin" in line]
    assert not exchanged


def test_a_last_capture_that_cannot_be_read_hides_older_ones(spark):
    records = spark.createDataFrame(
        [("c", "q1", 1, '{"state": "A"}'), ("c", "q1", 2, '{"state": '), ("c", "q2", 1, '{"state": "B"}'), ("c", "q2", 2, '{"state": "C"}')],
        "cluster string, query_id string, captured_at long, document string")
    found = queries.flat_tables(records)["query_info"].select("query_id", "state").collect()
    assert [tuple(r) for r in found] == [("q2", "C")]


def test_escaped_names_of_inner_stages_are_found(spark):
    records = spark.createDataFrame(
        [("c", "q1", r'{"stages": [{"stage_id": "a", "subStages": [{"stage_id": "b"}]}]}'), ("c", "q2", '{"stages": [{"stage_id": "a"}]}')],
        "cluster string, query_id string, document string")
    parsed = queries.parsed_documents(records)
    found = queries.flatten_query(parsed, "stages").select("query_id", "stage_id").collect()
    assert sorted(map(tuple, found)) == [("q1", "a"), ("q1", "b"), ("q2", "a")]
    assert [r.query_id for r in parsed.where("nests").collect()] == ["q1"]


def test_nested_documents_take_one_exchange(spark):
    assert _plan(standins.nested_documents(spark, SF)).count("Exchange ") == 1


def test_a_small_table_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(standins, "ROWS_PER_TASK", 40)
    customers = standins.table(spark, SF, "customer").count()
    assert standins.node_files(spark, SF).rdd.getNumPartitions() == -(-customers // 40) > 1


def test_anomalies_read_their_entries_twice(spark):
    entries = spark.createDataFrame([("c", "r", "n", "f", "k", "1", "number")], "cluster string, role string, node string, file string, key string, raw string, kind string")
    assert _plan(anomalies(entries), optimized=True).count("LogicalRDD") == 2
