"""Detectors on saved query documents, reports, profiles, estimates and search."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleet_audit import fixed_values, schemas
from fleet_audit.functions.nesting import nest_rows
from fleet_audit.operators import report, telemetry
from fleet_audit.operators.detectors import registry
from fleet_audit.operators.detectors.exploding_join import join_fanout
from fleet_audit.operators.median import grouped_median
from fleet_audit.operators.predicates import classify_predicate
from fleet_audit.operators.scan_estimate import column_share, estimate_scan
from fleet_audit.operators.search import search_recommendations
from fleet_audit.operators.tables import partition_info, stats_stale, table_stats
from fleet_audit.operators.thresholds import Thresholds, default_thresholds, with_overrides, with_thresholds
from fleet_audit.sources.metadata import combine_listings
from fleet_audit.sources.queries import bad_documents, fill_from_runtime, flat_tables, parse_snapshots, read_query_documents
from fleet_audit.streaming import ingest

MB = 2**20


def scan(table="t", parts=range(1), predicate="ds = 1", size=64 * MB):
    return [{"table": table, "partition": p, "partition_column": "ds", "predicate": predicate,
             "files": [{"path": f"f{p}", "bytes": size}]} for p in parts]


def document(cluster="c1", **changes):
    op = {"operator_id": "o1", "operator": "join", "input_rows": 100, "output_rows": 100, "build_bytes": 1, "spilled_bytes": 0}
    base = {
        "cluster": cluster, "state": "FINISHED", "elapsed_ms": 1000, "queued_ms": 10, "peak_memory": 5,
        "stages": [{"stage_id": "s1", "operators": [op | changes.pop("operator", {})],
                    "tasks": [{"task_id": str(i), "wall_ms": w} for i, w in enumerate(changes.pop("tasks", [10, 10, 10]))]}],
        "scans": scan(), "dynamic_filters": [{"id": "d", "input_rows": 100, "output_rows": 50}],
    }
    return base | changes


# One document that fires each detector, and one just under its threshold.
FIRING = {
    "no_partition_pruning": (document(scans=scan("p", range(9), "year(ds) = 1")), document(scans=scan("p", range(8), "year(ds) = 1"))),
    "exploding_join": (document(operator={"output_rows": 1001}), document(operator={"output_rows": 1000})),
    "bad_broadcast": (document(operator={"build_bytes": 100 * MB + 1}), document(operator={"build_bytes": 100 * MB})),
    "missing_stats": (document(scans=scan("no_stats")), document(scans=scan("t"))),
    "skew": (document(tasks=[10, 10, 51, 10]), document(tasks=[10, 10, 50, 10])),
    "small_files": (document(scans=scan(size=16 * MB - 1)), document(scans=scan(size=16 * MB))),
    "spilling": (document(operator={"spilled_bytes": 1}), document(operator={"spilled_bytes": 0})),
    "not_the_querys_fault": (document(queued_ms=501), document(queued_ms=500)),
    "ineffective_dynamic_filter": (document(dynamic_filters=[{"id": "d", "input_rows": 100, "output_rows": 91}]),
                                   document(dynamic_filters=[{"id": "d", "input_rows": 100, "output_rows": 90}])),
}


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    for name, (fires, silent) in FIRING.items():
        (folder / f"{name}+.json").write_text(json.dumps(fires))
        (folder / f"{name}-.json").write_text(json.dumps(silent))
    (folder / "broken.json").write_text('{"state": "FINI')
    (folder / "empty.json").write_text('{"cluster": "c1", "state": "QUEUED"}')
    return read_query_documents(spark, str(folder)).persist()


@pytest.fixture(scope="module")
def references(spark):
    return {
        "table_files": spark.createDataFrame(
            [("p", i, f"f{i}", "ORC", 1) for i in range(10)] + [("t", 0, "f", "ORC", 1)],
            "table_id string, part bigint, path string, format string, bytes bigint"),
        "column_stats": spark.createDataFrame(
            [("no_stats", "a", None, 10), ("no_stats", "b", 5, 10), ("t", "a", 3, 10), ("p", "a", 3, 10)],
            "table_id string, column_name string, ndv bigint, row_count bigint"),
    }


@pytest.fixture(scope="module")
def tables(records, references):
    return {**flat_tables(records), **references}


@pytest.fixture(scope="module")
def found(spark, tables):
    return report.analyze_queries(tables, default_thresholds(spark)).persist()


def test_bad_documents_are_set_aside(records):
    assert [r.query_id for r in bad_documents(records).collect()] == ["broken"]
    assert parse_snapshots(records).count() == records.count() - 1


def test_each_detector_fires_on_its_document_only(found):
    fired = {(r.rule_id, r.evidence.query_id) for r in found.collect()}
    assert fired == {(name, f"{name}+") for name in FIRING}
    assert list(FIRING) == list(registry()) == list(fixed_values.DETECTORS)


def test_findings_schema_and_evidence(spark, found):
    assert found.schema.simpleString() == spark.createDataFrame([], schemas.FINDINGS).schema.simpleString()
    rows = {r.rule_id: r for r in found.collect()}
    assert rows["no_partition_pruning"].evidence.cause == "wrapped_predicate"
    assert rows["no_partition_pruning"].actual == "9 of 10"
    assert rows["skew"].actual == "5.1x" and rows["skew"].evidence.stage_id == "s1"
    assert rows["bad_broadcast"].expected == "at most 100MB"
    assert rows["missing_stats"].evidence.cause == "a"
    assert all(r.rationale and r.evidence.metric for r in rows.values())


def test_reports_tell_what_ran(tables, found):
    rows = {r.query_id: r for r in report.query_reports(tables, found).collect()}
    assert len(rows) == 2 * len(FIRING) + 1
    assert rows["skew+"].detectors_run == list(fixed_values.DETECTORS) and rows["skew+"].detectors_skipped == []
    assert [f.rule_id for f in rows["skew+"].findings] == ["skew"]
    assert rows["empty"].query_state == "QUEUED" and rows["empty"].findings is None
    assert rows["empty"].detectors_run == ["not_the_querys_fault"]
    assert len(rows["empty"].detectors_skipped) == 8


def test_reports_exchange_wordings_as_numbers_and_give_them_back(spark, tables, found, monkeypatch):
    again = found.union(found.withColumns({"severity": F.lit(None).cast("string"), "actual": F.lit("9")}))
    reports = lambda: report.query_reports(tables, again).select("cluster", "query_id", "part", "parts", "findings")
    assert "_before" in reports()._jdf.queryExecution().optimizedPlan().toString()
    numbered = sorted(str(r) for r in reports().collect())
    assert any("rationale='" in text for text in numbered)
    monkeypatch.setattr(report, "MAX_WORDINGS", 0)
    assert numbered == sorted(str(r) for r in reports().collect())


def test_scans_are_not_exchanged_to_meet_a_few_tables(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [registry()["missing_stats"].detect(tables, default_thresholds(spark)), report.detector_coverage(tables)]
        assert all("SortMergeJoin" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_tables_skip_detectors(spark, tables):
    fewer = {k: v for k, v in tables.items() if k not in ("table_files", "column_stats")}
    row = report.detector_coverage(fewer).where("query_id = 'skew+'").first()
    assert row.detectors_skipped == ["no_partition_pruning", "missing_stats"]
    assert "missing_stats" not in {r.rule_id for r in report.analyze_queries(fewer, default_thresholds(spark)).collect()}


def test_queueing_comes_first(found):
    ranks = [r["rank"] for r in report.rank_findings(found).collect()]
    assert ranks == sorted(ranks) and report.rank_findings(found).first().rule_id == "not_the_querys_fault"


def test_details_of_what_fired(found, tables):
    on = {"cluster": "cluster", "query_id": "query_id", "stage_id": "stage_id"}
    detail = telemetry.fetch_if_fired(found, ["skew"], tables["tasks"], on).collect()
    assert {r.query_id for r in detail} == {"skew+"} and len(detail) == 4


def test_query_report_and_lookup(tables):
    rows = telemetry.query_lookup(telemetry.query_report(tables), "c1", "skew+").collect()
    assert len(rows) == 1 and rows[0].elapsed_ms == 1000
    assert len(rows[0].stages) == 1 and rows[0].operators[0].operator == "join"
    assert telemetry.query_report(tables).where("query_id = 'empty'").first().stages is None


def test_long_reports_continue_in_parts(spark, tables):
    ops = spark.range(500).selectExpr(
        "'f' as fleet", "'c1' as cluster", "'skew+' as query_id", "'s' as stage_id", "string(id) as operator_id")
    nested = telemetry.query_report({**tables, "operators": ops}, rows_per_part=50)
    rows = telemetry.query_lookup(nested, "c1", "skew+").collect()
    assert sorted(r.part for r in rows) == list(range(11)) and {r.parts for r in rows} == {11}  # 500 operators, a stage
    assert sorted(int(o.operator_id) for r in rows for o in r.operators or []) == list(range(500))
    assert sum(len(r.stages or []) for r in rows) == 1


def test_nesting_keeps_every_row(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 100).cast("string")).alias("k"), "id")
    rows = nest_rows(df, ["k"], F.col("id"), "ids", rows_per_part=100).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(10_000))
    hot = [r for r in rows if r.k == "hot"]
    assert len(hot) == 34 and max(len(r.ids) for r in hot) < 200


@pytest.mark.parametrize("predicate, expected", [
    ("ds = 1", "other"), ("year(ds) = 1", "wrapped_predicate"), ("cast(ds as varchar) = '1'", "wrapped_predicate"),
    (None, "no_predicate"), ("x = 1", "no_predicate"), ("ds in (1, 2)", "other"), ("1 in (ds, 2)", "other"),
    ("lower(x) = 'a' and ds = 1", "other"), ("substr(concat(x), 1) = '' and date_trunc('day', DS) > 1", "wrapped_predicate"),
    ("dsx = 1", "no_predicate"), ("not (ds = 1)", "other"),
])
def test_predicates(spark, predicate, expected):
    row = spark.createDataFrame([(predicate, "ds")], "predicate string, partition_column string")
    assert classify_predicate(row).first().predicate_class == expected


@pytest.mark.parametrize("rows_per_task, broadcast_limit", [(100_000, 10), (1000, 10), (2, 1000), (2, 1)])
def test_median_equals_numpy(spark, rows_per_task, broadcast_limit):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.lognormal(5, 3, 3000), 3)]
    rows += [("hot", 7.0)] * 1500  # copies of one value
    rows += [(f"g{i}", float(v)) for i in range(40) for v in np.round(rng.exponential(50, i % 7 + 1), 2)]
    rows += [("neg", -5.0), ("neg", -1.5), ("neg", 0.0), ("neg", 2.0), (None, 1.0), (None, 4.0), ("nulls", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in grouped_median(frame, ["k"], "v", rows_per_task, broadcast_limit).collect()}
    expected = {}
    for k, v in rows:
        if v is not None:
            expected.setdefault(k, []).append(v)
    assert got.keys() == expected.keys()
    for k, values in expected.items():
        assert got[k].median == pytest.approx(np.median(values)) and got[k].max_value == max(values)
        assert got[k].rows == len(values)


def test_threshold_lookup_and_join_agree(spark):
    own = spark.createDataFrame([("skew", "f1", "max_over_median", 8.0), ("skew", None, "max_over_median", 6.0)], schemas.THRESHOLDS)
    limits = with_overrides(default_thresholds(spark), own)
    frame = spark.createDataFrame([("f1",), ("f2",), (None,)], "fleet string")
    joined = Thresholds(limits, None)
    assert Thresholds.of(limits, limit=3).values is None
    for t in (limits, joined):
        got = {r.fleet: r.threshold for r in with_thresholds(frame, t, "skew", "max_over_median").collect()}
        assert got == {"f1": 8.0, "f2": 6.0, None: 6.0}
        assert with_thresholds(frame.drop("fleet"), t, "spilling", "spilled_bytes").first().threshold == 0.0
    assert with_thresholds(frame, limits, "spilling", "spilled_bytes").first().threshold == 0.0


def test_fanout_without_joining(spark):
    left = spark.createDataFrame([(1,)] * 30 + [(2,)], "k int")
    right = spark.createDataFrame([(1,)] * 20 + [(3,)], "k int")
    assert [(r.k, r.output_rows, r.ratio) for r in join_fanout(left, right, ["k"]).collect()] == [(1, 600, 12.0)]


def test_latest_snapshot_keeps_the_last_of_many_repeats(spark):
    rows = [("c", "hot", i % 50, i) for i in range(400)] + [("c", "q2", 1, 1), ("d", "hot", 9, 9)]
    df = spark.createDataFrame(rows, "cluster string, query_id string, t long, snapshot_id long").withColumn(
        "captured_at", F.timestamp_seconds("t"))
    got = {(r.cluster, r.query_id): r.snapshot_id for r in telemetry.latest_snapshot(df).collect()}
    assert got == {("c", "hot"): 399, ("c", "q2"): 1, ("d", "hot"): 9}


def test_runtime_fills_only_holes(spark):
    schema = "cluster string, query_id string, state string, elapsed_ms long, queued_ms long, peak_memory long"
    info = spark.createDataFrame([("c", "a", None, 5, None, 1), ("c", "b", "X", 1, 1, 1)], schema)
    runtime = spark.createDataFrame([("c", "a", "FINISHED", 9, 2, 9), ("c", "z", "FAILED", 1, 1, 1)], schema)
    got = {r.query_id: (r.state, r.elapsed_ms, r.queued_ms) for r in fill_from_runtime(info, runtime).collect()}
    assert got == {"a": ("FINISHED", 5, 2), "b": ("X", 1, 1)}


def test_table_stats(spark):
    long_a, long_b = "a" * 100, "a" * 99 + "b"
    df = spark.createDataFrame([(1, "é", [1.0]), (1, None, None), (None, long_a, [1.0]), (2, long_b, [2.0]), (3, long_b, [1.0])],
                               "i int, s string, a array<double>")
    exact = {r.column_name: (r.row_count, r.ndv, r.nulls, r["size"]) for r in table_stats(df, "t", exact=True).collect()}
    assert exact == {"i": (5, 3, 1, 16), "s": (5, 3, 1, 302), "a": (5, 2, 1, 32)}
    sketch = {r.column_name: (r.row_count, r.ndv, r.nulls, r["size"]) for r in table_stats(df, "t").collect()}
    assert sketch == exact
    nothing = {r.column_name: (r.row_count, r.ndv, r.nulls, r["size"]) for r in table_stats(df.limit(0), "t", exact=True).collect()}
    assert set(nothing.values()) == {(0, 0, 0, 0)}
    assert {r["size"] for r in table_stats(df.limit(0), "t").collect()} == {0}


def test_stale_stats(spark):
    frame = lambda rows: spark.createDataFrame(rows, "table_id string, row_count bigint")
    got = stats_stale(frame([("a", 109), ("b", 111), ("c", None)]), frame([("a", 100), ("b", 100), ("c", 5)]), default_thresholds(spark))
    assert {r.table_id: r.stats_stale for r in got.collect()} == {"a": False, "b": True, "c": True}


def test_layout_of_both_kinds_of_listing(spark):
    hive = spark.createDataFrame([("t", 1, "ORC", 10), ("t", 2, "ORC", 20)], "table_id string, part bigint, format string, bytes bigint")
    iceberg = spark.createDataFrame([("t", 2, "p", "PARQUET", 60)], "table_id string, part bigint, path string, format string, bytes bigint")
    row = partition_info(combine_listings(hive, iceberg)).first()
    assert (row.partition_count, row.files, row.avg_file_bytes, row.format) == (2, 3, 30.0, "ORC")


def test_estimates_equal_brute_force(spark):
    rng = random.Random(5)
    files = [(f"t{rng.randrange(3)}", rng.randrange(-50, 20_000), rng.randrange(1000)) for _ in range(2000)]
    scans = []
    for i in range(300):
        low = rng.randrange(-100, 20_100)
        scans.append((f"s{i}", f"t{rng.randrange(4)}", low, low + rng.choice([-1, 0, 5, 4096, 30_000])))
    limits = spark.createDataFrame([("estimate_scan", None, "scan_bytes", 100_000.0)], schemas.THRESHOLDS)
    got = estimate_scan(
        spark.createDataFrame(scans, "scan_id string, table_id string, low bigint, high bigint"),
        spark.createDataFrame(files, "table_id string, part bigint, bytes bigint"), limits).collect()
    assert len(got) == len(scans)
    wanted = {s: (t, lo, hi) for s, t, lo, hi in scans}
    for r in got:
        t, lo, hi = wanted[r.scan_id]
        hit = [(p, b) for ft, p, b in files if ft == t and lo <= p <= hi]
        assert r.estimated_scan_bytes == sum(b for _, b in hit) and r.partitions == len({p for p, _ in hit})
        assert r.safe_to_run == (r.estimated_scan_bytes <= 100_000 and t != "t3")
        assert bool(r.warnings) == (not r.safe_to_run or not hit)


def test_column_share(spark):
    stats = spark.createDataFrame([("t", "a", 30), ("t", "b", 70)], "table_id string, column_name string, size bigint")
    columns = spark.createDataFrame([("s", "t", "a"), ("s", "t", "a"), ("s2", "u", "a")], "scan_id string, table_id string, column_name string")
    assert [(r.scan_id, r.share) for r in column_share(stats, columns).collect()] == [("s", 0.3)]


def _bm25(passages, queries, k):
    tokens = {i: re.findall(r"[^\W_]+", t.lower()) for i, t, _ in passages}
    df = Counter(w for ws in tokens.values() for w in set(ws))
    average = sum(map(len, tokens.values())) / len(tokens)
    out = []
    for q, text, version in queries:
        scored = []
        for i, _, least in passages:
            if least is not None and version < least:
                continue
            score, tf = 0.0, Counter(tokens[i])
            for w in set(re.findall(r"[^\W_]+", text.lower())) & set(tf):
                idf = math.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5))
                score += idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(tokens[i]) / average))
            if score > 0:
                scored.append((-round(score, 6), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("per_pass", [256, 3])
def test_search_equals_brute_force(spark, per_pass):
    rng = random.Random(11)
    vocabulary = ["the"] * 30 + [f"w{i}" for i in range(60)] + ["Élan", "straße"]
    passages = [(f"p{i:03d}", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))), rng.choice([None, 410, 420])) for i in range(300)]
    passages += [(f"copy{i}", "the w1 w2 w3", None) for i in range(50)]  # equal scores
    queries = [(f"q{i}", " ".join(rng.choices(vocabulary, k=6)), rng.choice([405, 415, 425])) for i in range(10)]
    queries += [("none", "unheard of", 425), ("blank", "  ", 425)]
    got = search_recommendations(
        spark.createDataFrame([(i, t, "d", 1, None if v is None else f">={v}") for i, t, v in passages], schemas.PASSAGES).repartition(5),
        spark.createDataFrame([(q, t, str(v)) for q, t, v in queries], "query_id string, query string, engine_version string"),
        k=4, queries_per_pass=per_pass).collect()
    assert sorted((r.query_id, r["rank"], r.passage_id, r.score) for r in got) == _bm25(passages, queries, 4)


@pytest.mark.parametrize("per_pass", [256, 0])
def test_search_with_repeated_ids_and_copies(spark, per_pass):
    passages = [("p1", "heap memory limits", None), ("p1", "heap memory limits", None), ("p1", "other words on heap", None), ("p2", "memory", ">=420"), ("p3", None, None), ("p4", "", None)]
    df = spark.createDataFrame([(i, t, "d", 1, v) for i, t, v in passages], schemas.PASSAGES).repartition(3)
    queries = [("q", "heap", "410")] * 40 + [("q", "memory", "410"), (None, "limits", None), ("r", "?!", "1"), ("s", "memory", "425")]
    asked = spark.createDataFrame(queries, "query_id string, query string, engine_version string")
    found = sorted((r.query_id or "", r["rank"], r.passage_id, r.text) for r in search_recommendations(df, asked, 2, per_pass).collect())
    assert found == [("", 1, "p1", "heap memory limits"), ("q", 1, "p1", "heap memory limits"), ("q", 2, "p1", "other words on heap"),
                     ("s", 1, "p2", "memory"), ("s", 2, "p1", "heap memory limits")]
    assert search_recommendations(df.limit(0), asked, 2, per_pass).count() == search_recommendations(df, asked.limit(0), 2, per_pass).count() == 0


def test_hot_terms_are_spread_and_skipped(spark, monkeypatch):
    from fleet_audit.operators import search as operators_search

    monkeypatch.setattr(operators_search, "POSTINGS_PER_KEY", 50)
    texts = [f"the of a w{i} w{i % 7}" for i in range(400)]
    df = spark.createDataFrame([(f"p{i}", t, "d", 1, None) for i, t in enumerate(texts)], schemas.PASSAGES).repartition(4)
    asked = spark.createDataFrame([(f"q{i}", f"the of a w{i}", None) for i in range(30)], "query_id string, query string, engine_version string")
    met = []
    meet = operators_search._meet

    def counted(terms, postings):
        met.append({r.term for r in terms.select("term").distinct().collect()})
        return meet(terms, postings)

    monkeypatch.setattr(operators_search, "_meet", counted)
    monkeypatch.setattr(operators_search, "STRONG_TERMS", 1)
    got = search_recommendations(df, asked, 1, 0).collect()
    want = _bm25([(f"p{i}", t, None) for i, t in enumerate(texts)], [(f"q{i}", f"the of a w{i}", "1") for i in range(30)], 1)
    assert sorted((r.query_id, r["rank"], r.passage_id, r.score) for r in got) == want
    assert all(not {"the", "of", "a"} & terms for terms in met)  # they are in every passage and decide nothing


def test_search_in_blocks_equals_brute_force(spark, monkeypatch):
    """Common terms only, so that every query meets most passages: they are scored in blocks, and no pair of a query and a posting is exchanged."""
    from fleet_audit.operators import search as operators_search
    from fleet_audit.operators import search_blocks

    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    passages = [(f"p{i:03d}", " ".join(rng.choices(words, k=rng.randrange(1, 30))), rng.choice([None, 410, 420])) for i in range(250)]
    passages += [(f"copy{i}", "w1 w2 w3", None) for i in range(30)]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=4)), rng.choice([405, 415, 425])) for i in range(40)]
    monkeypatch.setattr(operators_search, "MOST_MET", 1000)
    monkeypatch.setattr(operators_search, "_meet", None)
    monkeypatch.setattr(search_blocks, "POSTINGS_PER_BLOCK", 300)
    monkeypatch.setattr(search_blocks, "TERMS_PER_CHUNK", 50)
    df = spark.createDataFrame([(i, t, "d", 1, None if v is None else f">={v}") for i, t, v in passages], schemas.PASSAGES).repartition(3)
    asked = spark.createDataFrame([(q, t, str(v)) for q, t, v in queries] + [("unknown", "w1 w2", None)], "query_id string, query string, engine_version string")
    got = sorted((r.query_id, r["rank"], r.passage_id, r.score) for r in search_recommendations(df, asked, 4, 0).collect())
    assert got == _bm25(passages, [*queries, ("unknown", "w1 w2", 0)], 4)
    # Copies of one passage under several gates are one, and rows of one id are questions of their own.
    monkeypatch.setattr(operators_search, "MOST_MET", 0)
    copied = [("p1", "heap limits", ">=420"), ("p1", "heap limits", None), ("p1", "heap limits", ">=420"), ("p1", "other words on heap", None), ("p2", "memory", ">=420")]
    df = spark.createDataFrame([(i, t, "d", 1, v) for i, t, v in copied], schemas.PASSAGES).repartition(3)
    asked = spark.createDataFrame([("q", "heap", "430"), ("q", "memory", "410"), ("s", "memory", "425")], "query_id string, query string, engine_version string")
    found = sorted((r.query_id, r["rank"], r.passage_id, r.text) for r in search_recommendations(df, asked, 2, 0).collect())
    assert found == [("q", 1, "p1", "heap limits"), ("q", 2, "p1", "other words on heap"), ("s", 1, "p2", "memory")]


def test_stream_keeps_late_documents(spark, tmp_path):
    schema = "cluster string, query_id string, captured_at timestamp, snapshot_id long, document string"
    for batch in range(4):  # newest first
        rows = [(f"c{i % 2}", f"q{i % 5}", i) for i in range(100 * (3 - batch), 100 * (4 - batch))]
        spark.createDataFrame(rows, "cluster string, query_id string, n long").select(
            "cluster", "query_id", F.timestamp_seconds(F.col("n") * 7200).alias("captured_at"), F.col("n").alias("snapshot_id"),
            F.lit("{}").alias("document")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    def run():
        stream = ingest.snapshot_stream(spark, str(tmp_path / "in"), schema=schema, files_per_batch=1)
        ingest.ingest_snapshots_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    run()  # nothing new, nothing doubled
    saved = spark.read.parquet(str(tmp_path / "out"))
    assert saved.count() == 400 and saved.select("snapshot_id").distinct().count() == 400
    last = {(r.cluster, r.query_id): r.snapshot_id for r in telemetry.latest_snapshot(saved).collect()}
    assert len(last) == 10 and max(last.values()) == 399


def test_stream_analysis_equals_batch(spark, tmp_path, records, references, found):
    (records.repartition(3).write.json(str(tmp_path / "in")))
    stream = ingest.snapshot_stream(
        spark, str(tmp_path / "in"), files_per_batch=1)
    ingest.analyze_stream(
        stream, str(tmp_path / "out"), str(tmp_path / "check"), default_thresholds(spark), references).awaitTermination()
    streamed = ingest.current_findings(spark, str(tmp_path / "out"))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, found.collect()))


def test_retention_risk(spark):
    runtime = spark.createDataFrame([("c", "saved", "FINISHED", "2024-01-01"), ("c", "old", "FAILED", "2024-01-01"),
                                     ("c", "new", "FINISHED", "2024-01-09"), ("c", "live", "RUNNING", "2024-01-01")],
                                    "cluster string, query_id string, state string, ended_at string")
    snapshots = spark.createDataFrame([("c", "saved")], "cluster string, query_id string")
    got = ingest.retention_risk(snapshots, runtime, 5 * 86400, "2024-01-10")
    assert [r.query_id for r in got.collect()] == ["old"]


def test_queries_times_passages_exchange_little():
    from fleet_audit.operators.search_blocks import blocks_and_chunks

    entries, terms = 300_000_000, 1_900_000
    blocks, chunks = blocks_and_chunks(entries, terms)
    assert entries * chunks + terms * blocks < 500_000_000
