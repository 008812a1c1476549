"""Registered queries on configuration backups: parsing, rules, consistency, guidance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit import fixed_values
from fleet_audit.findings import all_findings, rule_id_delta
from fleet_audit.functions.nesting import nest_rows
from fleet_audit.functions.text import normalized
from fleet_audit.functions.versions import gate_array, version_array, version_in_gate
from fleet_audit.operators import clusters, consistency, enrich, normalize, redaction, rules, versions
from fleet_audit.operators.audit import audit_config
from fleet_audit.operators.scope import resolve_scope
from fleet_audit.operators.search import search_recommendations
from fleet_audit.plans import oracle, standins
from fleet_audit.plans.query_audit import brief
from fleet_audit.sources import context as contexts
from fleet_audit.sources import parsers
from fleet_audit.sources.stores import materialize

C = F.col

#: Key patterns for documents, which hold secrets under another name.
DOCUMENT_PATTERNS = (*fixed_values.SENSITIVE_KEYS, "*token*")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_values(parsers.parse_all(standins.config_files(spark, sf_dir)))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.context_rows(standins.guidance(spark, sf_dir))


def _snapshot(spark: SparkSession, sf_dir: str, hinted: bool = True) -> DataFrame:
    files = standins.config_files(spark, sf_dir)
    context = _context(spark, sf_dir) if hinted else None
    return versions.config_snapshot(files, parsers.properties_entries(files), context)


def _with_lines(entries: DataFrame) -> DataFrame:
    return entries.select("cluster", "role", "node", "file", C("line").cast("bigint").alias("line"), "key", "raw")


def properties_entries(spark, sf_dir):
    return _with_lines(parsers.properties_entries(standins.node_files(spark, sf_dir)))


def jvm_entries(spark, sf_dir):
    return _with_lines(parsers.jvm_entries(standins.node_files(spark, sf_dir)))


def hive_site_entries(spark, sf_dir):
    return _with_lines(parsers.hive_site_entries(standins.hms_files(spark, sf_dir)))


def ranger_entries(spark, sf_dir):
    return _with_lines(parsers.ranger_entries(standins.ranger_files(spark, sf_dir)))


def assignment_entries(spark, sf_dir):
    return parsers.assignment_entries(standins.document_files(spark, sf_dir)).select(
        "cluster", "file", C("line").cast("bigint").alias("line"), "key", "raw")


def normalized_values(spark, sf_dir):
    return _entries(spark, sf_dir).select(
        "cluster", "node", "key", "raw", "kind", C("num").cast("double").alias("num"), "unit")


def scope_filtered(spark, sf_dir):
    entries = parsers.parse_all(standins.config_files(spark, sf_dir))
    return _with_lines(normalize.scope_filter(entries, standins.rules(spark), ["memory", "general"]))


def sensitive_keys(spark, sf_dir):
    entries = parsers.assignment_entries(standins.document_files(spark, sf_dir))
    return redaction.sensitive_keys(entries, DOCUMENT_PATTERNS).select(
        "cluster", "file", C("line").cast("bigint").alias("line"), "key")


def redaction_violations(spark, sf_dir):
    found = redaction.file_violations(standins.config_files(spark, sf_dir))
    return brief(redaction.redaction_findings(found)).drop("fleet")


def config_detail(spark, sf_dir):
    files = standins.document_files(spark, sf_dir)
    violations = redaction.verify_redaction(parsers.assignment_entries(files), DOCUMENT_PATTERNS)
    return redaction.config_detail(files, violations, free_text="^doc-").select(
        "cluster", "file", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"),
        "redaction_verified")


def role_gate(spark, sf_dir):
    """Entries each rule looks at, before its version is considered."""
    entries = parsers.parse_all(standins.config_files(spark, sf_dir))
    snapshot = _snapshot(spark, sf_dir, hinted=False).withColumn("version", version_array(F.lit("420")))
    checked = standins.rules(spark).withColumn("gates", gate_array(F.lit(None).cast("string")))
    looked = rules.entries_per_rule(normalize.normalize_values(entries), checked, snapshot)
    return looked.groupBy("rule_id", "role").agg(F.count(F.lit(1)).alias("entries"))


def version_gate(spark, sf_dir):
    return versions.version_gate(standins.rules(spark), _snapshot(spark, sf_dir))


def resolve_version(spark, sf_dir):
    return _snapshot(spark, sf_dir).select(
        "cluster", "engine_version", F.get("version", F.lit(0)).cast("bigint").alias("major"), "version_source")


def run_rules(spark, sf_dir):
    return brief(rules.run_rules(_entries(spark, sf_dir), standins.rules(spark), _snapshot(spark, sf_dir))).drop("fleet")


def run_rules_in_scope(spark, sf_dir):
    found = rules.run_rules(
        _entries(spark, sf_dir), standins.rules(spark), _snapshot(spark, sf_dir), ["memory"])
    return found.select("cluster", "rule_id", C("evidence.file").alias("file"), C("evidence.line").cast("bigint").alias("line"),
                        C("doc_ref.source").alias("doc"), C("doc_ref.version").alias("doc_version"),
                        C("doc_ref.page").cast("bigint").alias("page"), C("doc_ref.anchor").alias("anchor"))


def rule_run_counts(spark, sf_dir):
    return versions.rule_run_counts(standins.rules(spark), _snapshot(spark, sf_dir))


def unevaluable_rules(spark, sf_dir):
    return rules.unevaluable_rules(
        _entries(spark, sf_dir).where("key <> '-Xmx'"), standins.rules(spark), _snapshot(spark, sf_dir))


def diff_clusters(spark, sf_dir):
    return clusters.diff_clusters(_entries(spark, sf_dir), "c3", "c8")


def heap_mismatch(spark, sf_dir):
    return brief(consistency.check_heap_mismatch(_entries(spark, sf_dir))).select("cluster", "rule_id", "actual", "expected")


def catalog_hms(spark, sf_dir):
    return brief(consistency.check_catalog_hms(_entries(spark, sf_dir))).select("cluster", "actual", "expected", "cause")


def environment_drift(spark, sf_dir):
    return brief(consistency.check_environment_drift(_entries(spark, sf_dir))).select("cluster", "actual", "expected", "cause")


def fleet_drift(spark, sf_dir):
    """Versions instead of names, as the usual name is the same in every cluster."""
    found = consistency.check_fleet_drift(_entries(spark, sf_dir).where("role = 'worker'"), "task.concurrency")
    nodes = consistency.check_fleet_drift(_entries(spark, sf_dir), "-Xmx")
    return brief(all_findings(found, nodes)).select("cluster", "property", "actual", "expected")


def all_config_findings(spark, sf_dir):
    found = audit_config(standins.config_files(spark, sf_dir), standins.rules(spark), _context(spark, sf_dir))
    return found.groupBy("cluster", "rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def enriched(spark, sf_dir):
    found = rules.run_rules(_entries(spark, sf_dir), standins.rules(spark), _snapshot(spark, sf_dir))
    index = contexts.passages_from(standins.table(spark, sf_dir, "documents").select(
        "text", F.when(C("doc_id") % 2 == 0, "Deployment Guide").otherwise("Tuning Guide").alias("source_doc"),
        (C("doc_id") % 9).cast("int").alias("page"), F.concat(F.lit("d"), C("doc_id").cast("string")).alias("passage_id")))
    context = _context(spark, sf_dir).where("kind = 'passage' or property <> 'task.concurrency'")
    return enrich.enrich(found, context, index).groupBy("rule_id", "rationale_source", F.md5("rationale").alias("reason")).agg(
        F.count(F.lit(1)).alias("findings"))


def enriched_per_cluster(spark, sf_dir):
    """Guidance of some clusters and of all, and passages for some versions only."""
    snapshot = _snapshot(spark, sf_dir)
    found = rules.run_rules(_entries(spark, sf_dir), standins.rules(spark), snapshot)
    number, none = C("p_partkey"), F.lit(None).cast("string")
    context = standins.table(spark, sf_dir, "part").where("p_partkey % 4 < 3").select(
        F.when(number % 4 > 0, F.concat(F.lit("c"), (number % 25).cast("string"))).alias("cluster"), F.lit("outside").alias("source"),
        F.when(number % 4 == 1, "passage").otherwise("property").alias("kind"),
        F.when(number % 4 != 1, F.when(number % 3 == 0, "task.concurrency").otherwise("node.environment")).alias("property"), C("p_name").alias("text"),
        F.when(number % 4 == 1, "Memory Guide").alias("doc"), F.when(number % 4 == 1, (14 + number % 2).cast("int")).alias("page"), none.alias("engine_version_hint"))
    index = contexts.passages_from(standins.table(spark, sf_dir, "documents").select(
        F.md5("text").alias("text"), F.when(C("doc_id") % 2 == 0, "Memory Guide").otherwise("Tuning Guide").alias("source_doc"),
        F.when(C("doc_id") % 2 == 0, 15).otherwise(8).alias("page"), F.concat(F.lit(">="), (415 + C("doc_id") % 20).cast("string")).alias("engine_version"),
        F.concat(F.lit("d"), C("doc_id").cast("string")).alias("passage_id")))
    return enrich.enrich(found, context, index, snapshot).groupBy("cluster", "rule_id", "rationale_source", "rationale").agg(F.count(F.lit(1)).alias("findings"))


def context_independence(spark, sf_dir):
    """Rule ids with guidance against without it, for clusters whose version is detected."""
    files, context = standins.config_files(spark, sf_dir), _context(spark, sf_dir)
    entries = materialize(_entries(spark, sf_dir))
    with_hint, without = (versions.config_snapshot(files, entries, c).where("version_source = 'detected'") for c in (context, None))
    plain = rules.run_rules(entries.join(without.select("cluster"), "cluster", "left_semi"), standins.rules(spark), without)
    hinted = rules.run_rules(entries.join(with_hint.select("cluster"), "cluster", "left_semi"), standins.rules(spark), with_hint)
    delta = rule_id_delta(enrich.enrich(hinted, context), plain)
    compared = plain.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    return compared.join(delta.groupBy("rule_id").agg(F.sum("times").alias("surplus")), "rule_id", "left").select(
        "rule_id", "findings", F.coalesce("surplus", F.lit(0)).alias("surplus"))


def uncovered_guidance(spark, sf_dir):
    return enrich.annotate_uncovered(_context(spark, sf_dir), standins.rules(spark)).drop("cluster")


def guidance_conflicts(spark, sf_dir):
    return enrich.guidance_conflicts(_context(spark, sf_dir), standins.rules(spark)).drop("cluster")


def best_rationale(spark, sf_dir):
    events = standins.table(spark, sf_dir, "events").select(
        "user_id", F.when(C("event_type") == "error", 0).when(C("event_type") == "purchase", 1).otherwise(2).alias("priority"),
        F.concat("event_type", "props").alias("text"))
    return enrich.best_rationale(events, ["user_id"]).select("user_id", C("priority").cast("bigint").alias("priority"), "text")


def list_clusters(spark, sf_dir):
    return clusters.list_clusters(_snapshot(spark, sf_dir)).select(
        "name", "engine_version", F.unix_seconds("backed_up_at").alias("backed_up_at"),
        F.array_join("roles", ",").alias("roles"))


def summary_properties(spark, sf_dir):
    return clusters.summary_properties(_entries(spark, sf_dir))


def capped_summary(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return clusters.cap_summary(clusters.summary_properties(entries), 3).select(
        "cluster", "role", "key", "values", C("position").cast("bigint").alias("position"))


def config_summary(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return clusters.config_summary(entries, _snapshot(spark, sf_dir)).select(
        "cluster", F.size("properties").cast("bigint").alias("properties"), "properties_total",
        F.size("source_files").cast("bigint").alias("files"), F.size("anomalies").cast("bigint").alias("anomalies"),
        F.element_at("properties", "worker.node.environment").alias("environment"), "engine_version")


def anomalies(spark, sf_dir):
    return clusters.anomalies(_entries(spark, sf_dir))


SIGNALS = (("ther|thing", ("memory", "jvm")), ("inthing", ("hms",)), ("erblest", ("ranger", "hms", "auth")))


def resolved_scopes(spark, sf_dir):
    signals = spark.createDataFrame(SIGNALS, "signal string, scopes array<string>")
    questions = standins.table(spark, sf_dir, "conversations").where("role = 'user'")
    return resolve_scope(questions, signals, "text").select(
        "conv_id", "turn", F.array_join("scopes", ",").alias("scopes"), F.round("confidence", 6).alias("confidence"),
        F.array_join("all_scopes", ",").alias("all_scopes"))


def search(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents").select(
        C("doc_id").cast("string").alias("passage_id"), "text", C("source").alias("source_doc"),
        F.concat(F.lit(">="), (400 + C("doc_id") % 30).cast("string")).alias("engine_version"))
    queries = standins.table(spark, sf_dir, "benchmark").select(
        C("item_id").cast("string").alias("query_id"), C("text").alias("query"),
        (405 + C("item_id") % 25).cast("string").alias("engine_version"))
    found = search_recommendations(contexts.passages_from(documents), queries, k=5)
    return found.select("query_id", C("rank").cast("bigint").alias("rank"), "passage_id", "source_doc",
                        F.length("text").cast("bigint").alias("chars"), "score")


def search_by_index(spark, sf_dir):
    """A query per conversation, each asked twice, in the passages that documents are; more than one pass over the passages would hold."""
    documents = standins.table(spark, sf_dir, "documents").select(
        C("doc_id").cast("string").alias("passage_id"), "text", C("source").alias("source_doc"),
        F.concat(F.lit(">="), (400 + C("doc_id") % 30).cast("string")).alias("engine_version"))
    asked = standins.table(spark, sf_dir, "conversations").where("turn = 0").select(
        (C("conv_id") % 400).cast("string").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("query"),
        (405 + C("conv_id") % 25).cast("string").alias("engine_version"))
    found = search_recommendations(contexts.passages_from(documents), asked.unionAll(asked), k=5, queries_per_pass=0)
    return found.select("query_id", C("rank").cast("bigint").alias("rank"), "passage_id", "source_doc", "score")


# Expected results. ``n`` and ``h`` are the nodes and metastore nodes behind the files.
_CTES = {
    "n": """select c_custkey as k, c_nationkey as nat, concat('c', c_nationkey) as cluster,
        case when c_mktsegment = 'BUILDING' then 'coordinator' else 'worker' end as role,
        concat('n', c_custkey) as node from customer""",
    "h": """select s_suppkey as s, s_nationkey as nat, concat('c', s_nationkey) as cluster from supplier""",
    "props": """
        select cluster, role, node, 'config.properties' as file, 2 as line, 'coordinator' as key,
               case when role = 'coordinator' then 'true' else 'false' end as raw from n
        union all select cluster, role, node, 'config.properties', 3, 'query.max-memory-per-node',
               case when k % 75 = 7 then 'lots' else concat(5 + k % 23, 'GB') end from n
        union all select cluster, role, node, 'config.properties', 5, 'internal-communication.shared-secret',
               case when k % 97 = 0 then concat('s3cr3t-', k) else '${ENV:SHARED}' end from n
        union all select cluster, role, node, 'config.properties', 6, 'task.concurrency',
               case when k % 3 = 0 then '32' else '16' end from n
        union all select cluster, role, node, 'config.properties', 7, 'query.max-memory-per-node', '10GB'
               from n where k % 50 = 0
        union all select cluster, role, node, 'node.properties', 1, 'node.environment',
               case when k % 40 = 0 then 'staging' else 'production' end from n
        union all select cluster, role, node, 'node.properties', 2, 'node.id', node from n
        union all select cluster, role, node, 'node.properties', 3, 'node.version', cast(405 + nat as varchar)
               from n where role = 'coordinator' and nat % 6 <> 0
        union all select cluster, role, node, 'catalog/hive.properties', 1, 'connector.name', 'hive' from n
        union all select cluster, role, node, 'catalog/hive.properties', 2, 'hive.metastore.uri',
               concat('thrift://hms-', nat + case when k % 60 = 0 then 1 else 0 end, ':9083') from n""",
    "jvm": """
        select cluster, role, node, 'jvm.config' as file, 1 as line, '-server' as key, '' as raw from n
        union all select cluster, role, node, 'jvm.config', 2, '-Xmx', concat(64 + 16 * (k % 2), 'G') from n
        union all select cluster, role, node, 'jvm.config', 3, 'UseG1GC', 'true' from n""",
    "hms": """
        select cluster, 'hms' as role, concat('h', s) as node, 'hive-site.xml' as file, 3 as line,
               'hive.metastore.uris' as key,
               concat('thrift://hms-', case when s % 30 = 7 then 'old' else cast(nat as varchar) end, ':9083') as raw from h
        union all select cluster, 'hms', concat('h', s), 'hive-site.xml', 7, 'javax.jdo.option.ConnectionPassword',
               case when s % 41 = 3 then 'hunter2' else '********' end from h""",
    "policies": """
        select cluster, 'ranger' as role, concat('r', s) as node, 'policies.json' as file, 2 + i as line, concat('policy.', i, '.', field) as key,
               case field when 'id' then cast(i as varchar) when 'name' then concat('p-', s) else case i when 1 then 'true' else 'false' end end as raw
        from h, (values (1), (2)) p(i), (values ('id'), ('name'), ('isEnabled')) f(field)""",
    "entries": "select * from props union all select * from jvm union all select * from hms union all select * from policies",
    "masked": """select *, case when key ilike '%password%' and raw = 'hunter2' then '********'
        when key ilike '%secret%' and raw like 's3cr3t%' then '********' else raw end as shown from entries""",
    "values_": """select *,
        case when raw in ('true', 'false') then 'boolean'
             when key = '-Xmx' then 'size' when regexp_matches(raw, '^[0-9]+GB$') then 'size'
             when regexp_matches(raw, '^[0-9]+$') then 'number' else 'text' end as kind,
        case when raw = 'true' then 1.0 when raw = 'false' then 0.0
             when key = '-Xmx' or regexp_matches(raw, '^[0-9]+GB$') then
               cast(regexp_extract(raw, '^([0-9]+)', 1) as double) * 1073741824.0
             when regexp_matches(raw, '^[0-9]+$') then cast(raw as double) end as num from entries""",
    "hint": "select max(cast(400 + p_size as varchar)) as v from part where p_partkey % 1000 = 5",
    "known": "select cluster, nat from n union select cluster, nat from h",
    "snap": """select k.cluster, k.nat, d.v as detected, coalesce(d.v, (select v from hint)) as engine_version,
        cast(coalesce(d.v, (select v from hint)) as bigint) as version,
        case when d.v is not null then 'detected' when (select v from hint) is not null then 'hint' else 'unknown' end as version_source
        from known k left join (select cluster, max(raw) as v from props where key = 'node.version' group by all) d
        on k.cluster = d.cluster""",
    "heap": "select cluster, role, node, num as jvm_heap from values_ where key = '-Xmx'",
}
_RULE_COLUMNS = {
    "MEM-001": ("memory", "role = 'coordinator'", "version >= 413"),
    "MEM-002": ("memory", "role = 'worker'", "version >= 420"),
    "ENV-001": ("general", "role = 'worker'", "true"),
    "CON-001": ("tasks", "true", "version < 425"),
}


def _memory_rule(rule_id: str, share: str, percent: str) -> str:
    domain, role, gate = _RULE_COLUMNS[rule_id]
    limit = oracle.human_bytes(f"jvm_heap * {share}")
    return f"""select v.cluster, '{rule_id}' as rule_id, 'high' as severity, key as property, shown as actual,
        concat('<= ', {limit}, ' ({percent}% of ', {oracle.human_bytes('jvm_heap')}, ' heap)') as expected,
        num as value, v.role, v.file, v.line from v join heap using (cluster, role, node) join snap using (cluster)
        where key = 'query.max-memory-per-node' and v.{role} and {gate} and num > jvm_heap * {share}"""


_FIRED = f"""
    {_memory_rule('MEM-001', '0.3', '30')}
    union all {_memory_rule('MEM-002', '0.25', '25')}
    union all select cluster, 'ENV-001', 'medium', key, shown, '= production', num, role, file, line from v
        where key = 'node.environment' and role = 'worker' and raw <> 'production'
    union all select v.cluster, 'CON-001', 'low', key, shown, '<= 16', num, role, file, line from v join snap using (cluster)
        where key = 'task.concurrency' and version < 425 and num > 16"""
_CTES["v"] = "select v.*, m.shown from values_ v join masked m using (cluster, role, node, file, line, key)"
_CTES["fired"] = _FIRED
_CTES["usual_env"] = """select cluster, raw as usual from (select cluster, raw, count(*) as c from props
    where key = 'node.environment' group by all)
    qualify row_number() over (partition by cluster order by c desc, raw) = 1"""
_CTES["drift"] = """select p.cluster, raw as actual, usual as expected, node as cause from props p
    join usual_env using (cluster) where key = 'node.environment' and raw <> usual"""
_CTES["wrong_hms"] = """select p.cluster, raw as actual, e.uri as expected_uri, e.uris, node as cause from props p
    join (select cluster, min(raw) as uri, count(distinct raw) as uris from hms
          where key = 'hive.metastore.uris' group by all) e using (cluster)
    where key = 'hive.metastore.uri' and not exists (select 1 from hms h where h.cluster = p.cluster
          and h.key = 'hive.metastore.uris' and h.raw = p.raw)"""
_CTES["heaps"] = """select cluster, min(jvm_heap) filter (role = 'coordinator') as cl, max(jvm_heap) filter (role = 'coordinator') as ch,
    min(jvm_heap) filter (role = 'worker') as wl, max(jvm_heap) filter (role = 'worker') as wh from heap group by all
    having least(cl, wl) <> greatest(ch, wh) and cl is not null and wl is not null"""
_CTES["exposed"] = """select cluster, concat(role, '/', file) as file, line, key from masked where shown <> raw"""
_CTES["guided"] = """select case p_partkey % 3 when 0 then 'query.max-memory-per-node' when 1 then 'task.concurrency'
      else concat('session.', lower(replace(p_brand, '#', '-'))) end as property,
    concat('recommended <= ', p_size, case when p_partkey % 3 = 0 then '% heap' else '' end) as text,
    p_size, p_partkey from part"""
_CTES["passages"] = """select concat('set task.concurrency <= ', p_size, ' on small nodes') as text, p_size as page,
    case when p_partkey % 2 = 0 then 'Memory Guide' else 'Tuning Guide' end as doc from part"""
_CTES["summary"] = """select cluster, role, key, min(shown) as value, count(distinct raw) as values,
    min(file) as source_file from masked group by all"""
_CTES["odd"] = """
    select 'repeated_key' as kind, cluster, role, node, file, key, count(*) as n from entries
      group by cluster, role, node, file, key having count(*) > 1
    union all select 'differing_values', cluster, role, null, null, key, count(distinct raw) from entries
      group by cluster, role, key having count(distinct raw) > 1
    union all select 'unparseable', cluster, role, null, null, key, count(*) filter (kind = 'text') from values_
      group by cluster, role, key having count(*) filter (kind = 'text') > 0
        and count(*) filter (kind <> 'text') > count(*) filter (kind = 'text')"""

_BASE = ["n", "h", "props", "jvm", "hms", "policies", "entries", "masked", "values_", "hint", "known", "snap", "heap", "v", "fired"]


def _sql(body: str, *more: str) -> str:
    return oracle.with_ctes(_CTES, [*_BASE, *more], body)


def _rule_rows(pick: Callable[[str, str, str, str], str]) -> str:
    return " union all ".join(pick(rule, *columns) for rule, columns in _RULE_COLUMNS.items())


_PROPERTY = {"MEM-001": "query.max-memory-per-node", "MEM-002": "query.max-memory-per-node",
             "ENV-001": "node.environment", "CON-001": "task.concurrency"}
_DOC = {"MEM-001": ("Memory Guide", "413+", 14), "MEM-002": ("Memory Guide", "420+", 15)}
_PAIRS = """select cluster, file, line, key, raw from (
    select source as cluster, concat('doc-', doc_id) as file, unnest(string_split(text, chr(10))) as l,
           generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
    lateral (select unnest(regexp_extract_all(l, '([A-Za-z_][A-Za-z0-9_.-]*)"?\\s*[=:]\\s*"([^"]*)"', 1)) as key,
                    unnest(regexp_extract_all(l, '([A-Za-z_][A-Za-z0-9_.-]*)"?\\s*[=:]\\s*"([^"]*)"', 2)) as raw)"""
_SECRET_KEY = "regexp_matches(lower(key), 'password|secret|keytab|credential|token')"

def signed_numbers(spark, sf_dir):
    """Raw values with a sign and seven decimals, one per line item."""
    sign = F.when(C("l_linenumber") % 2 == 0, "-").otherwise("+")
    raw = F.concat(sign, C("l_partkey").cast("string"), F.lit("."), F.lpad(C("l_suppkey").cast("string"), 7, "0"))
    items = standins.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return normalized(items, F.lit(False)).select("l_orderkey", "l_linenumber", "kind", C("num").cast("double").alias("num"))


def long_versions(spark, sf_dir):
    """Versions of four parts against a gate that differs in the fourth only."""
    parts = [C(c).cast("int").cast("string") for c in ("l_linenumber", "l_quantity", "l_partkey")]
    version, gate = F.concat_ws(".", *parts, C("l_suppkey").cast("string")), F.concat(F.lit(">"), F.concat_ws(".", *parts, F.lit("5")))
    return standins.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", version_in_gate(version_array(version), gate_array(gate)).alias("met"))


def ordered_parts(spark, sf_dir):
    """Line items nested under their flag, 500 a part, and taken apart again with part and place."""
    items = standins.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    nested = nest_rows(items, ["l_returnflag"], F.struct("l_orderkey", "l_linenumber"), "items", rows_per_part=500)
    return nested.select("l_returnflag", "part", "parts", F.posexplode("items").alias("place", "i")).select(
        "l_returnflag", "part", "parts", "place", "i.l_orderkey", "i.l_linenumber")


QUERIES = {
    "signed_numbers": signed_numbers,
    "long_versions": long_versions,
    "ordered_parts": ordered_parts,
    "properties_entries": properties_entries,
    "jvm_entries": jvm_entries,
    "hive_site_entries": hive_site_entries,
    "ranger_entries": ranger_entries,
    "assignment_entries": assignment_entries,
    "normalize_values": normalized_values,
    "scope_filter": scope_filtered,
    "sensitive_keys": sensitive_keys,
    "verify_redaction": redaction_violations,
    "config_detail": config_detail,
    "role_gate": role_gate,
    "version_gate": version_gate,
    "resolve_version": resolve_version,
    "run_rules": run_rules,
    "run_rules_in_scope": run_rules_in_scope,
    "rule_run_counts": rule_run_counts,
    "unevaluable_rules": unevaluable_rules,
    "diff_clusters": diff_clusters,
    "check_heap_mismatch": heap_mismatch,
    "check_catalog_hms": catalog_hms,
    "check_environment_drift": environment_drift,
    "check_fleet_drift": fleet_drift,
    "all_config_findings": all_config_findings,
    "enrich": enriched,
    "enrich_per_cluster": enriched_per_cluster,
    "context_independence": context_independence,
    "annotate_uncovered": uncovered_guidance,
    "guidance_conflicts": guidance_conflicts,
    "best_rationale": best_rationale,
    "list_clusters": list_clusters,
    "summary_properties": summary_properties,
    "cap_summary": capped_summary,
    "config_summary": config_summary,
    "anomalies": anomalies,
    "resolve_scope": resolved_scopes,
    "search_recommendations": search,
    "search_repeated_ids": search_by_index,
}

_LINE = "cast(line as bigint) as line"
ORACLES = {
    "signed_numbers": """
        select l_orderkey, l_linenumber, 'number' as kind, cast(cast(concat(case when l_linenumber % 2 = 0 then '-' else '+' end,
               l_partkey, '.', lpad(cast(l_suppkey as varchar), 7, '0')) as decimal(30, 6)) as double) as num from lineitem""",
    "long_versions": "select l_orderkey, l_linenumber, l_suppkey > 5 as met from lineitem",
    "ordered_parts": """
        select l_returnflag, cast(n // 500 as integer) as part, cast((total + 499) // 500 as integer) as parts, cast(n % 500 as integer) as place,
               l_orderkey, l_linenumber
        from (select *, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) - 1 as n,
                     count(*) over (partition by l_returnflag) as total from lineitem)""",
    "properties_entries": _sql(f"select * replace ({_LINE}) from props"),
    "jvm_entries": _sql(f"select * replace ({_LINE}) from jvm"),
    "hive_site_entries": _sql(f"select * replace ({_LINE}) from hms"),
    "ranger_entries": """
        select concat('c', s_nationkey) as cluster, 'ranger' as role, concat('r', s_suppkey) as node,
               'policies.json' as file, cast(2 + i as bigint) as line, concat('policy.', i, '.', field) as key,
               case field when 'id' then cast(i as varchar) when 'name' then concat('p-', s_suppkey)
                          else case i when 1 then 'true' else 'false' end end as raw
        from supplier, (values (1), (2)) p(i), (values ('id'), ('name'), ('isEnabled')) f(field)""",
    "assignment_entries": _PAIRS,
    "normalize_values": _sql("""select cluster, node, key, raw, kind, num,
        case when kind = 'size' then 'bytes' end as unit from values_"""),
    "scope_filter": _sql(f"""select * replace ({_LINE}) from entries
        where key in ('query.max-memory-per-node', 'node.environment')"""),
    "sensitive_keys": f"select cluster, file, line, key from ({_PAIRS}) where {_SECRET_KEY}",
    "verify_redaction": _sql("select * exclude (fleet) from (" + oracle.finding(
        "exposed", cluster="cluster", rule_id="'redaction'", severity="'high'", property="key",
        actual="'********'", expected="'a placeholder'", cause="'unredacted_value'") + ")", "exposed"),
    "config_detail": f"""
        select source as cluster, concat('doc-', doc_id) as file, length(text) as chars, md5(text) as digest,
               true as redaction_verified from documents
        where concat('doc-', doc_id) not in (select file from ({_PAIRS}) where {_SECRET_KEY}
              and not regexp_matches(raw, '^\\s*(\\**|x{{3,}}|<[^<>]*>)\\s*$'))""",
    "role_gate": _sql("select rule_id, role, count(*) as entries from (" + _rule_rows(
        lambda rule, domain, role, gate: f"select '{rule}' as rule_id, role from entries where key = '{_PROPERTY[rule]}' and {role}"
    ) + ") group by all"),
    "version_gate": _sql(_rule_rows(
        lambda rule, domain, role, gate: f"select cluster, '{rule}' as rule_id, coalesce({gate}, false) as applies from snap")),
    "resolve_version": _sql("select cluster, engine_version, version as major, version_source from snap"),
    "run_rules": _sql(f"""select * exclude (fleet) from ({oracle.finding('fired', cluster='cluster', rule_id='rule_id',
        severity='severity', property='property', actual='actual', expected='expected', metric="'value'", value='value')})"""),
    "run_rules_in_scope": _sql(f"""select cluster, rule_id, concat(role, '/', file) as file, {_LINE},
        case rule_id {' '.join(f"when '{r}' then '{d[0]}'" for r, d in _DOC.items())} end as doc,
        case rule_id {' '.join(f"when '{r}' then '{d[1]}'" for r, d in _DOC.items())} end as doc_version,
        cast(case rule_id {' '.join(f"when '{r}' then {d[2]}" for r, d in _DOC.items())} end as bigint) as page,
        property as anchor from fired where rule_id like 'MEM-%'"""),
    "rule_run_counts": _sql("""select cluster,
        1 + (coalesce(version >= 413, false))::bigint + (coalesce(version >= 420, false))::bigint
          + (coalesce(version < 425, false))::bigint as rules_evaluated,
        3 - (coalesce(version >= 413, false))::bigint - (coalesce(version >= 420, false))::bigint
          - (coalesce(version < 425, false))::bigint as rules_skipped_version from snap"""),
    "unevaluable_rules": _sql("""select cluster, cast(sum(u) as bigint) as rules_unevaluable from (
        select distinct e.cluster, 'MEM-001' as rule, 1 as u from entries e join snap using (cluster)
          where key = 'query.max-memory-per-node' and e.role = 'coordinator' and version >= 413
        union all select distinct e.cluster, 'MEM-002', 1 from entries e join snap using (cluster)
          where key = 'query.max-memory-per-node' and e.role = 'worker' and version >= 420
        union all select distinct cluster, 'ENV-001', 0 from entries where key = 'node.environment' and role = 'worker'
        union all select distinct e.cluster, 'CON-001', 0 from entries e join snap using (cluster)
          where key = 'task.concurrency' and version < 425) group by cluster"""),
    "diff_clusters": _sql("""
        , sides as (select role, key, raw, min(shown) as shown, max(cluster = 'c3') as in_a, max(cluster = 'c8') as in_b
            from masked where cluster in ('c3', 'c8') group by role, key, raw)
        select key as property, coalesce(min(shown) filter (in_a and not in_b), min(shown) filter (in_a)) as a,
               coalesce(min(shown) filter (in_b and not in_a), min(shown) filter (in_b)) as b, role
        from sides group by role, key having max(in_a <> in_b)"""),
    "check_heap_mismatch": _sql(f"""select cluster, 'heap_mismatch' as rule_id,
        concat('coordinator ', case when cl = ch then {oracle.human_bytes('cl')} else
                 concat({oracle.human_bytes('cl')}, ' to ', {oracle.human_bytes('ch')}) end,
               ', worker ', case when wl = wh then {oracle.human_bytes('wl')} else
                 concat({oracle.human_bytes('wl')}, ' to ', {oracle.human_bytes('wh')}) end) as actual,
        'one heap size' as expected from heaps""", "heaps"),
    "check_catalog_hms": _sql("""select cluster, actual,
        concat(expected_uri, case when uris > 1 then concat(' and ', uris - 1, ' more') else '' end) as expected, cause
        from wrong_hms""", "wrong_hms"),
    "check_environment_drift": _sql("select * from drift", "usual_env", "drift"),
    "check_fleet_drift": _sql(" union all ".join(f"""
        select cluster, '{key}' as property, usual as actual, fleet as expected from
          (select cluster, raw as usual from entries where key = '{key}' and {role} group by cluster, raw
             qualify row_number() over (partition by cluster order by count(*) desc, raw) = 1) c,
          (select usual as fleet from (select cluster, raw as usual from entries where key = '{key}' and {role} group by cluster, raw
             qualify row_number() over (partition by cluster order by count(*) desc, raw) = 1)
             group by usual order by count(*) desc, usual limit 1) f
        where usual <> fleet""" for key, role in (("task.concurrency", "role = 'worker'"), ("-Xmx", "true")))),
    "all_config_findings": _sql("""select cluster, rule_id, severity, count(*) as findings from (
        select cluster, rule_id, severity from fired
        union all select cluster, 'heap_mismatch', 'medium' from heaps
        union all select cluster, 'catalog_hms_mismatch', 'high' from wrong_hms
        union all select cluster, 'environment_drift', 'medium' from drift
        union all select cluster, 'fleet_environment_drift', 'low' from
          (select cluster, raw as usual from entries where key = 'node.environment' group by cluster, raw
             qualify row_number() over (partition by cluster order by count(*) desc, raw) = 1) c,
          (select usual as fleet from (select cluster, raw as usual from entries where key = 'node.environment' group by cluster, raw
             qualify row_number() over (partition by cluster order by count(*) desc, raw) = 1)
             group by usual order by count(*) desc, usual limit 1) f
        where usual <> fleet
        union all select cluster, 'redaction', 'high' from exposed) group by all""",
        "heaps", "wrong_hms", "usual_env", "drift", "exposed"),
    "enrich": _sql("""
        , docs as (select * from (values ('MEM-001', 'Memory Guide', 14), ('MEM-002', 'Memory Guide', 15),
             ('ENV-001', 'Deployment Guide', 3), ('CON-001', 'Tuning Guide', 8)) d(rule_id, doc, page)),
          own as (select * from (values ('MEM-001', 'Planning and metadata share this heap with the queries.'),
             ('MEM-002', 'Exchange buffers and readers need heap beside the queries.'),
             ('ENV-001', 'Nodes of one cluster share an environment name.'),
             ('CON-001', 'More tasks than cores only wait for each other.')) o(rule_id, text)),
          said as (select doc, page, min(text) as text from passages group by all),
          by_property as (select property, min(text) as text from guided where property <> 'task.concurrency' group by all),
          local as (select case when doc_id % 2 = 0 then 'Deployment Guide' else 'Tuning Guide' end as doc,
               cast(doc_id % 9 as integer) as page, min(text) as text from documents group by all)
        select rule_id, rationale_source, md5(text) as reason, count(*) as findings from (
          select f.rule_id,
            case when said.text is not null then 'context_passage' when p.text is not null then 'context_property'
                 when local.text is not null then 'local_index' else 'rule_catalog' end as rationale_source,
            coalesce(said.text, p.text, local.text, own.text) as text
          from fired f join docs on f.rule_id = docs.rule_id join own on f.rule_id = own.rule_id
          left join said on said.doc = docs.doc and said.page = docs.page
          left join by_property p on p.property = f.property
          left join local on local.doc = docs.doc and local.page = docs.page) group by all""", "guided", "passages"),
    "enrich_per_cluster": _sql("""
        , docs as (select * from (values ('MEM-001', 'Memory Guide', 14), ('MEM-002', 'Memory Guide', 15),
             ('ENV-001', 'Deployment Guide', 3), ('CON-001', 'Tuning Guide', 8)) d(rule_id, doc, page)),
          own as (select * from (values ('MEM-001', 'Planning and metadata share this heap with the queries.'),
             ('MEM-002', 'Exchange buffers and readers need heap beside the queries.'),
             ('ENV-001', 'Nodes of one cluster share an environment name.'),
             ('CON-001', 'More tasks than cores only wait for each other.')) o(rule_id, text)),
          given as (select case when p_partkey % 4 > 0 then concat('c', p_partkey % 25) end as cluster, p_partkey % 4 = 1 as is_passage,
               case when p_partkey % 3 = 0 then 'task.concurrency' else 'node.environment' end as property, p_name as text, 14 + p_partkey % 2 as page
             from part where p_partkey % 4 < 3),
          said as (select cluster, page, min(text) as text from given where is_passage group by all),
          advised as (select cluster, property, min(text) as text from given where not is_passage group by all),
          listed as (select case when doc_id % 2 = 0 then 'Memory Guide' else 'Tuning Guide' end as doc, 415 + doc_id % 20 as since, min(md5(text)) as text
             from documents group by all),
          told as (select f.cluster, f.rule_id, s.text as s, coalesce(a.text, g.text) as p, own.text as o,
               (select min(l.text) from listed l where l.doc = docs.doc and docs.page in (8, 15) and l.since <= snap.version) as l
             from fired f join docs on f.rule_id = docs.rule_id join own on f.rule_id = own.rule_id join snap on snap.cluster = f.cluster
             left join said s on docs.doc = 'Memory Guide' and s.page = docs.page and s.cluster = f.cluster
             left join advised a on a.property = f.property and a.cluster = f.cluster
             left join advised g on g.property = f.property and g.cluster is null)
        select cluster, rule_id, case when s is not null then 'context_passage' when p is not null then 'context_property'
            when l is not null then 'local_index' else 'rule_catalog' end as rationale_source, coalesce(s, p, l, o) as rationale, count(*) as findings
        from told group by all"""),
    "context_independence": _sql("""select rule_id, count(*) as findings, cast(0 as bigint) as surplus
        from fired join snap using (cluster) where version_source = 'detected' group by all"""),
    "annotate_uncovered": _sql("""select 'unvalidated_guidance' as kind, property, text, 'low' as severity from guided
        where property like 'session.%'""", "guided"),
    "guidance_conflicts": _sql("""
        , stated as (select property, text, case when p_partkey % 3 = 0 then p_size / 100.0 else p_size end as said from guided
            union all select 'task.concurrency', text, page from passages),
          limits as (select * from (values ('query.max-memory-per-node', 'MEM-001', 'value <= 0.3 * jvm_heap', 0.3),
            ('query.max-memory-per-node', 'MEM-002', 'value <= 0.25 * jvm_heap', 0.25),
            ('task.concurrency', 'CON-001', 'value <= 16', 16.0)) l(property, rule_id, check_text, rule_limit))
        select 'guidance_conflict' as kind, property, concat(rule_id, ': ', check_text, ' | ', text) as text, 'low' as severity
        from stated join limits using (property) where cast(said as double) <> cast(rule_limit as double)""",
        "guided", "passages"),
    "best_rationale": """
        select user_id, cast(p as bigint) as priority, t as text from (select user_id,
            case event_type when 'error' then 0 when 'purchase' then 1 else 2 end as p, concat(event_type, props) as t from events)
        qualify row_number() over (partition by user_id order by p, t) = 1""",
    "list_clusters": _sql("""
        select cluster as name, engine_version, max(1700000000 + i) as backed_up_at,
               string_agg(distinct role, ',' order by role) as roles
        from (select cluster, role, k as i from n union all select cluster, 'hms', s from h
              union all select cluster, 'ranger', s from h) join snap using (cluster) group by all"""),
    "summary_properties": _sql("select * from summary", "summary"),
    "cap_summary": _sql("""select cluster, role, key, values, row_number() over w as position from summary
        window w as (partition by cluster order by values desc, key, role)
        qualify row_number() over w <= 3""", "summary"),
    "config_summary": _sql("""
        , f as (select cluster, count(*) as properties, count(*) as properties_total,
              max(case when role = 'worker' and key = 'node.environment' then value end) as environment
            from summary group by all),
          g as (select cluster, count(distinct file) as files from entries group by all),
          a as (select cluster, count(*) as anomalies from odd group by all)
        select f.cluster, properties, properties_total, files, anomalies, environment, engine_version
        from f join g using (cluster) join snap using (cluster) left join a using (cluster)""", "summary", "odd"),
    "anomalies": _sql("select * from odd", "odd"),
    "resolve_scope": """
        select conv_id, turn,
          array_to_string(list_sort(list_distinct(list_concat(case when a then ['memory', 'jvm'] else [] end,
            case when b then ['hms'] else [] end, case when c then ['ranger', 'hms', 'auth'] else [] end))), ',') as scopes,
          round((a::int + b::int + c::int) / 3, 6) as confidence,
          case when a or b or c then '' else 'auth,hms,jvm,memory,ranger' end as all_scopes
        from (select *, regexp_matches(text, '(?is)\\b(?:ther|thing)') as a, regexp_matches(text, '(?is)\\b(?:inthing)') as b,
                     regexp_matches(text, '(?is)\\b(?:erblest)') as c from conversations where role = 'user')""",
    "search_repeated_ids": """
        with tokens as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
        stats as (select count(*) as n, avg(len(w)) as avgdl from tokens),
        tf as (select doc_id, t, count(*) as f from (select doc_id, unnest(w) as t from tokens) group by all),
        df as (select t, count(*) as d from tf group by all),
        q as (select distinct conv_id, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:6], ' ')), '[\\p{L}\\p{N}]+')) as t
              from conversations where turn = 0),
        scored as (select conv_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2
              / (f + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 6) as score
            from q join df using (t) join tf using (t) join tokens using (doc_id), stats
            where 400 + doc_id % 30 <= 405 + conv_id % 25 group by conv_id, doc_id),
        best as (select conv_id % 400 as id, doc_id, max(score) as score from scored group by all)
        select cast(id as varchar) as query_id, row_number() over w as rank, cast(doc_id as varchar) as passage_id, source as source_doc, score
        from best join documents using (doc_id)
        window w as (partition by id order by score desc, cast(doc_id as varchar))
        qualify row_number() over w <= 5""",
    "search_recommendations": """
        with tokens as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
        stats as (select count(*) as n, avg(len(w)) as avgdl from tokens),
        tf as (select doc_id, t, count(*) as f from (select doc_id, unnest(w) as t from tokens) group by all),
        df as (select t, count(*) as d from tf group by all),
        q as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as t from benchmark),
        scored as (select item_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2
              / (f + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 6) as score
            from q join df using (t) join tf using (t) join tokens using (doc_id), stats
            where 400 + doc_id % 30 <= 405 + item_id % 25 group by item_id, doc_id)
        select cast(item_id as varchar) as query_id, row_number() over w as rank, cast(doc_id as varchar) as passage_id,
               source as source_doc, length(text) as chars, score
        from scored join documents using (doc_id)
        window w as (partition by item_id order by score desc, cast(doc_id as varchar))
        qualify row_number() over w <= 5""",
}
