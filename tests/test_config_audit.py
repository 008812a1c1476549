"""Rules, versions, redaction, cross-file checks and guidance on the hand-written backup."""

import ast
import inspect
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleet_audit.findings import flatten, rule_id_delta
from fleet_audit.functions.bounds import TooLargeError, bounded_rows
from fleet_audit.functions.checks import CheckError, names_used, validate_catalogue
from fleet_audit.functions.versions import gate_array, version_array, version_in_gate
from fleet_audit.operators import audit, clusters, consistency, enrich, redaction, rules as engine, versions
from fleet_audit.operators.normalize import scope_filter
from fleet_audit.operators.scope import resolve_scope
from fleet_audit.sources.catalog import default_scope_map, prepare_rules
from fleet_audit.sources.parsers import parse_all


@pytest.fixture(scope="module")
def snapshot(files, entries, context):
    return versions.config_snapshot(files, entries, context).persist()


@pytest.fixture(scope="module")
def found(entries, rules, snapshot):
    return engine.run_rules(entries, rules, snapshot).persist()


def test_example_finding(found):
    row = found.where("rule_id = 'MEM-002' and cluster = 'c1'").first()
    assert (row.severity, row.property, row.actual) == ("high", "query.max-memory-per-node", "40GB")
    assert row.expected == "<= 24GB (30% of 80GB heap)"
    assert row.rationale == "Leaves headroom for non-query JVM allocation."
    assert row.rationale_source == "rule_catalog"
    assert (row.evidence.file, row.evidence.line) == ("coordinator/config.properties", 27)
    assert row.doc_ref.asDict() == {
        "source": "Tuning Guide", "version": "413+", "page": 14, "anchor": "query.max-memory-per-node"}


def test_rules_fire_and_stay_silent(found):
    fired = sorted((r.cluster, r.rule_id, r.actual, r.evidence.line) for r in found.collect())
    assert fired == [("c1", "MEM-002", "40GB", 27), ("c1", "TASK-001", "32", 10), ("c2", "MEM-002", "40GB", 3)]


def test_counts_add_up_to_the_catalogue(rules, snapshot):
    counts = {r.cluster: (r.rules_evaluated, r.rules_skipped_version)
              for r in versions.rule_run_counts(rules, snapshot).collect()}
    assert counts == {"c1": (2, 1), "c2": (2, 1)}
    applied = versions.version_gate(rules, snapshot).where("applies").groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in applied} == {"c1": 2, "c2": 2}


def test_unknown_version_skips_gated_rules(files, entries, rules):
    blind = versions.config_snapshot(files, entries)
    assert {r.cluster: r.version_source for r in blind.collect()} == {"c1": "detected", "c2": "unknown"}
    assert engine.run_rules(entries, rules, blind).where("cluster = 'c2'").count() == 0


def test_detected_version_beats_hint(snapshot):
    seen = {r.cluster: (r.engine_version, r.version_source) for r in snapshot.collect()}
    assert seen == {"c1": ("429", "detected"), "c2": ("420", "hint")}


@pytest.mark.parametrize("version, gate, expected", [
    ("413", ">=413", True), ("412", ">=413", False), ("429", "413+", True), ("429.1", ">429", True),
    ("429", ">=413, <430", True), ("430", ">=413 <430", False), ("429", "429", True), ("429", "=430", False),
    (None, ">=1", False), (None, None, True), ("x", "<5", False), ("429", "<=429.0.0", True),
])
def test_version_gates(spark, version, gate, expected):
    frame = spark.createDataFrame([(version, gate)], "v string, g string")
    assert frame.select(version_in_gate(version_array(F.col("v")), gate_array(F.col("g")))).first()[0] is expected


def test_check_without_inputs_does_not_fire(entries, rules, snapshot):
    bare = entries.where("key <> '-Xmx'")
    assert engine.run_rules(bare, rules, snapshot).where("rule_id = 'MEM-002'").count() == 0
    counts = {r.cluster: r.rules_unevaluable for r in engine.unevaluable_rules(bare, rules, snapshot).collect()}
    assert counts == {"c1": 1, "c2": 1}


def test_totals_and_many_checks(spark, entries, snapshot):
    records = [(f"R{i}", "memory", (None, None), "query.max-memory-per-node", f"value <= {i + 1} * total_heap",
                "low", "r", "Guide") for i in range(5)]
    records.append(("N", "memory", ("worker", None), "query.max-memory-per-node", "total_nodes > 1 and value > 0", "low", "r", "G"))
    from fleet_audit import schemas
    catalogue = prepare_rules(spark.createDataFrame(records, schemas.RULE_RECORD))
    before, engine.CHECKS_PER_PASS = engine.CHECKS_PER_PASS, 2
    try:
        fired = {(r.cluster, r.rule_id) for r in engine.run_rules(entries, catalogue, snapshot).collect()}
    finally:
        engine.CHECKS_PER_PASS = before
    assert fired == {("c1", "N")}


@pytest.mark.parametrize("check", [
    "value <= secret", "java_method('a', 'b')", "value; drop table x", "value <= (select 1)", "reflect(value)",
    "value / 0 > 1", "`value` > 1", "", "value <= 0.3 * jvm_heap -- x",
])
def test_unsafe_checks_are_refused(check):
    with pytest.raises(CheckError):
        names_used(check)


def test_safe_checks():
    assert names_used("value <= 0.3 * jvm_heap and text <> 'x'") == {"value", "jvm_heap", "text"}


def test_catalogue_is_validated():
    rule = lambda i, severity: Row(rule_id=i, severity=severity, check="value > 1")
    assert validate_catalogue([rule("a", "low"), rule("b", "high")]) == {"value > 1": {"value"}}
    for bad in ([rule("a", "low"), rule("a", "low")], [rule("a", "urgent")]):
        with pytest.raises(CheckError):
            validate_catalogue(bad)


def test_engine_knows_no_context():
    assert "context" not in inspect.signature(engine.run_rules).parameters
    tree = ast.parse(Path(engine.__file__).read_text())
    imported = {n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
    imported |= {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
    assert not [m for m in imported if "context" in m or "enrich" in m]


def test_context_changes_no_rule_ids(files, entries, rules, context, snapshot):
    detected = snapshot.where("version_source = 'detected'")
    plain = engine.run_rules(entries, rules, versions.config_snapshot(files, entries))
    only = lambda f: f.join(detected.select("cluster"), "cluster", "left_semi")
    enriched = enrich.enrich(engine.run_rules(entries, rules, snapshot), context)
    assert rule_id_delta(only(enriched), only(plain)).count() == 0
    assert rule_id_delta(enriched, plain).count() == 1  # the hint lets a gated rule apply to c2


def test_enrichment_order(spark, found, context):
    index = spark.createDataFrame(
        [("p1", "from the index", "Tuning Guide", 20, None), ("p2", "never", "Tuning Guide", 14, None)],
        "passage_id string, text string, source_doc string, page int, engine_version string")
    reasons = lambda f: {r.rule_id: (r.rationale_source, r.rationale) for r in f.collect()}
    full = enrich.enrich(found, context, index)
    assert full.columns == found.columns and full.count() == found.count()
    assert reasons(full) == {
        "MEM-002": ("context_passage", "Keep query.max-memory-per-node <= 20% of the heap."),
        "TASK-001": ("context_property", "recommended 8")}
    assert reasons(enrich.enrich(found, None, index))["TASK-001"] == ("local_index", "from the index")
    assert reasons(enrich.enrich(found)) == reasons(found)


def test_notes(rules, context):
    uncovered = enrich.annotate_uncovered(context, rules).collect()
    assert [(n.kind, n.property) for n in uncovered] == [("unvalidated_guidance", "no.such.rule")]
    conflicts = {(n.kind, n.property, n.severity) for n in enrich.guidance_conflicts(context, rules).collect()}
    assert conflicts == {("guidance_conflict", "query.max-memory-per-node", "low"),
                         ("guidance_conflict", "task.concurrency", "low")}
    texts = [n.text for n in enrich.guidance_conflicts(context, rules).collect()]
    assert not any("30%" in t.split("|")[1] for t in texts)  # equal limits do not conflict


def test_redaction(files):
    violations = redaction.file_violations(files)
    assert [(v.cluster, v.file, v.line, v.key) for v in violations.collect()] == [
        ("c2", "config.properties", 2, "ldap.bind-password")]
    findings = redaction.redaction_findings(violations).collect()
    assert [f.severity for f in findings] == ["high"] and "hunter2" not in str(findings)
    detail = redaction.config_detail(files, violations)
    assert detail.where("cluster = 'c2' and file = 'config.properties'").count() == 0
    assert detail.count() == files.count() - 1 and detail.where("not redaction_verified").count() == 0
    one = redaction.config_detail(files, violations, "c1", "coordinator", "jvm.config").first()
    assert one.content.startswith("-server\n-Xmx80G")


@pytest.mark.parametrize("key, raw, exposed", [
    ("Bind-PASSWORD", "x1", True), ("a.secret.b", "${ENV:X}", False), ("keytab", "/etc/a.keytab", True),
    ("credential-x", "<redacted>", False), ("password", "", False), ("passwd", "open", False),
    ("password", "REDACTED", False), ("password", "not redacted", True), ("password", "xxx", False),
    ("password", "line\nbreak", True),
])
def test_placeholders(spark, key, raw, exposed):
    row = spark.createDataFrame([("c", "worker", "n", "f", 1, key, raw)],
                                "cluster string, role string, node string, file string, line int, key string, raw string")
    assert (redaction.verify_redaction(row).count() == 1) is exposed


def test_secrets_are_masked_in_every_view(entries):
    shown = [r.asDict() for r in clusters.summary_properties(entries).collect()]
    shown += [r.asDict() for r in clusters.diff_clusters(entries, "c1", "c2").collect()]
    assert "hunter2" not in str(shown) and redaction.MASK in str(shown)


def test_secret_is_masked_in_rule_findings(spark, entries, snapshot):
    from fleet_audit import schemas
    catalogue = prepare_rules(spark.createDataFrame(
        [("S", "auth", (None, None), "ldap.bind-password", "text = 'y'", "low", "r", "G")], schemas.RULE_RECORD))
    rows = flatten(engine.run_rules(entries, catalogue, snapshot)).collect()
    assert len(rows) == 1 and rows[0].actual == redaction.MASK and "hunter2" not in str(rows)


def test_files_that_cannot_be_checked(spark):
    schema = "cluster string, role string, node string, file string, content string"
    files = spark.createDataFrame([
        ("c", "worker", "n", "a.json", "{"), ("c", "worker", "n", "b.json", "{}"), ("c", "worker", "n", "c.bin", "x"),
        ("c", "worker", "n", "d.properties", "a=b")], schema)
    assert sorted(r.file for r in redaction.unverifiable(files).collect()) == ["a.json", "c.bin"]


def test_cross_file_checks(entries):
    heap = consistency.check_heap_mismatch(entries).collect()
    assert [(f.cluster, f.actual) for f in heap] == [("c1", "coordinator 80GB, worker 64GB to 72GB")]
    hms = consistency.check_catalog_hms(entries).collect()
    assert [(f.cluster, f.actual, f.expected) for f in hms] == [
        ("c1", "thrift://hms-old:9083", "thrift://hms-1:9083 and 1 more")]
    drift = consistency.check_environment_drift(entries).collect()
    assert [(f.cluster, f.actual, f.expected, f.evidence.file) for f in drift] == [
        ("c1", "staging", "production", "worker/node.properties")]


def test_inventory_and_summary(entries, snapshot):
    listed = {r.name: (r.engine_version, r.roles) for r in clusters.list_clusters(snapshot).collect()}
    assert listed == {"c1": ("429", ["coordinator", "hms", "ranger", "worker"]), "c2": ("420", ["coordinator"])}
    odd = {(r.kind, r.key) for r in clusters.anomalies(entries).where("cluster = 'c1'").collect()}
    assert {("repeated_key", "task.concurrency"), ("differing_values", "-Xmx")} <= odd
    summary = {r.cluster: r for r in clusters.config_summary(entries, snapshot, n=5).collect()}
    assert len(summary["c1"].properties) == 5 and summary["c1"].engine_version == "429"
    assert "coordinator.task.concurrency" in summary["c1"].properties


def test_summary_tells_what_it_leaves_out(spark, snapshot):
    rows = [("c1", "worker", "n", f"{'a' if k % 2 else 'b'}.properties", k, f"key{k}", "1", "number") for k in range(60)]
    rows += [("c1", "worker", "n", f, 1, "twice", "1", "number") for f in ("x.properties", "y.properties")]
    entries = spark.createDataFrame(rows, "cluster string, role string, node string, file string, line int, key string, raw string, kind string")
    found = clusters.config_summary(entries, snapshot).collect()
    assert {r.properties_total for r in found} == {61} and sum(len(r.properties or {}) for r in found) == clusters.SUMMARY_PROPERTIES
    assert sorted(f for r in found for f in r.source_files or []) == ["a.properties", "b.properties", "x.properties", "y.properties"]


def test_differences(entries):
    rows = {(r.role, r.property): (r.a, r.b) for r in clusters.diff_clusters(entries, "c1", "c2").collect()}
    assert rows[("coordinator", "hive.metastore.uri")] == ("thrift://hms-old:9083", "thrift://hms-9:9083")
    assert rows[("worker", "coordinator")] == ("false", None)
    assert ("coordinator", "query.max-memory-per-node") not in rows
    assert clusters.diff_clusters(entries, "c1", "c1").count() == 0


def test_scope(spark, entries, rules):
    keys = {r.key for r in scope_filter(entries, rules, ["tasks"]).collect()}
    assert keys == {"task.concurrency"}
    questions = spark.createDataFrame([
        ("queries are spilling",), ("why is the hive catalog so slow?",), ("I cannot access this table",),
        ("please validate the cluster",), ("hello",), ("out of Memory and cannot access table x",)], "question string")
    got = [(r.scopes, round(r.confidence, 3), r.all_scopes) for r in resolve_scope(questions, default_scope_map(spark)).collect()]
    everything = sorted({"memory", "jvm", "spill", "hive_catalog", "hms", "s3", "ranger", "auth", "all"})
    assert got == [
        (["jvm", "memory", "spill"], 0.25, []), (["hive_catalog", "hms", "s3"], 0.25, []),
        (["auth", "hms", "ranger"], 0.25, []), (["all"], 0.25, []), ([], 0.0, everything),
        (["auth", "hms", "jvm", "memory", "ranger", "spill"], 0.5, [])]


def test_whole_audit(files, rules, context):
    found = audit.audit_config(files, rules, context)
    assert sorted((r.cluster, r.rule_id) for r in found.collect()) == [
        ("c1", "MEM-002"), ("c1", "TASK-001"), ("c1", "catalog_hms_mismatch"), ("c1", "environment_drift"),
        ("c1", "heap_mismatch"), ("c2", "MEM-002"), ("c2", "redaction")]


def test_size_checks_raise_instead_of_cutting(spark):
    with pytest.raises(TooLargeError):
        bounded_rows(spark.range(11), "the table", 10)
    assert len(bounded_rows(spark.range(10), "the table", 10)) == 10


def test_properties_of_all_parsers_have_entries(files):
    assert parse_all(files).where("line is null").count() == 0


def test_guidance_of_another_cluster_changes_nothing(spark):
    from fleet_audit import schemas
    from fleet_audit.findings import to_findings
    from fleet_audit.operators.enrich import enrich

    fired = spark.createDataFrame([("c1", "p.x", 3), ("c2", "p.x", 3), (None, "p.x", 3), ("c1", "p.y", None)], "cluster string, property string, page int")
    found = to_findings(fired, rule_id="R", severity="low", rationale="own", cluster=F.col("cluster"), property=F.col("property"), doc_ref={"source": F.lit("G"), "page": F.col("page")})
    rows = [("c1", "property", "p.x", "for c1", None, None), (None, "property", "p.x", "for all", None, None), ("c2", "passage", None, "page of c2", "G", 3), ("c9", "passage", None, "page of c9", "G", 3)]
    context = spark.createDataFrame(rows, "cluster string, kind string, property string, text string, doc string, page int")
    said = {(r.cluster, r.property): (r.rationale, r.rationale_source) for r in enrich(found, context).collect()}
    assert said == {("c1", "p.x"): ("for c1", "context_property"), ("c2", "p.x"): ("page of c2", "context_passage"),
                    (None, "p.x"): ("for all", "context_property"), ("c1", "p.y"): ("own", "rule_catalog")}
    index = spark.createDataFrame([("1", "old", "G", 3, "<420"), ("2", "new", "G", 3, ">=420")], schemas.PASSAGES)
    versions = spark.createDataFrame([("c1", "425"), ("c2", "410")], "cluster string, engine_version string")
    said = {r.cluster: r.rationale for r in enrich(found.where("property = 'p.x'"), None, index, versions).collect()}
    assert said == {"c1": "new", "c2": "old", None: "own"}
