"""Registered queries on recorded queries: detectors, reports, profiles and estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.operators import report, scan_estimate, tables as profiles, telemetry
from fleet_audit.operators.detectors import registry
from fleet_audit.operators.detectors.exploding_join import join_fanout
from fleet_audit.operators.investigate import analyze_with_details
from fleet_audit.operators.predicates import classify_predicate
from fleet_audit.operators.thresholds import with_thresholds
from fleet_audit.plans import oracle, standins
from fleet_audit.sources.stores import materialize

C = F.col


def brief(findings: DataFrame) -> DataFrame:
    """Findings as flat columns, numbers rounded to six places."""
    e = C("evidence")
    return findings.select(
        "fleet", "cluster", "rule_id", "severity", "property", "actual", "expected",
        e.query_id.alias("query_id"), e.stage_id.alias("stage_id"), e.operator_id.alias("operator_id"),
        e.getField("table").alias("table_id"), e.metric.alias("metric"),
        F.round(e.value, 6).alias("value"), F.round(e.threshold, 6).alias("threshold"), e.cause.alias("cause"),
    )


def _detector(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: getattr(standins, t)(spark, sf_dir) for t in registry()[name].inputs}
        return brief(registry()[name].detect(frames, standins.thresholds(spark)))

    return run


def skew_of_hot_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew over stages with many tasks each."""
    return brief(registry()["skew"].detect({"tasks": standins.event_tasks(spark, sf_dir)}, standins.thresholds(spark)))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief(report.analyze_queries(standins.telemetry(spark, sf_dir), standins.thresholds(spark)))


def two_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief(analyze_with_details(standins.telemetry(spark, sf_dir), standins.thresholds(spark)).findings)


def followed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was looked up for each query and why, and the detectors that could judge it."""
    seen = analyze_with_details(standins.telemetry(spark, sf_dir), standins.thresholds(spark))
    ran = seen.coverage.select("cluster", "query_id", F.array_join("detectors_run", ",").alias("detectors_run"))
    return seen.followed.join(ran, ["cluster", "query_id"])


def fetched_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks looked up by stage two."""
    return analyze_with_details(standins.telemetry(spark, sf_dir), standins.thresholds(spark)).details["tasks"]


def query_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = standins.telemetry(spark, sf_dir)
    findings = materialize(report.analyze_queries(frames, standins.thresholds(spark)))
    reports = report.query_reports(frames, findings)
    joined = lambda c: F.array_join(c, ",")
    return reports.select(
        "cluster", "query_id", "query_state", joined("detectors_run").alias("detectors_run"),
        joined("detectors_skipped").alias("detectors_skipped"),
        F.coalesce(F.size("findings"), F.lit(0)).cast("bigint").alias("finding_count"),
        F.get("findings", F.lit(0)).getField("rule_id").alias("first_finding"),
    )


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.analyze_queries(standins.telemetry(spark, sf_dir), standins.thresholds(spark))
    return report.finding_counts(found).select("fleet", "cluster", "rule_id", "findings", C("level").cast("bigint"))


def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.analyze_queries(standins.telemetry(spark, sf_dir), standins.thresholds(spark))
    return report.rank_findings(found).select(
        C("rank").cast("bigint").alias("rank"), "rule_id", "cluster", C("evidence.query_id").alias("query_id"),
        "severity")


def thresholds_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = standins.query_info(spark, sf_dir).select("fleet", "cluster", "query_id")
    return with_thresholds(info, standins.thresholds(spark), "not_the_querys_fault", "queued_ratio")


def query_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.query_lookup(standins.operators(spark, sf_dir), "c7", "q1007")


def predicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_predicate(standins.scans(spark, sf_dir)).groupBy("table_id", "predicate_class").agg(
        F.count(F.lit(1)).alias("scans"))


def fanout_of_raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.table(spark, sf_dir, "events")
    keys = lambda kind: events.where(C("event_type") == kind).select("user_id")
    return join_fanout(keys("click"), keys("view"), ["user_id"]).where("ratio > 3").select(
        "user_id", "left_rows", "right_rows", "output_rows", F.round("ratio", 6).alias("ratio"))


def tasks_of_skewed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = standins.event_tasks(spark, sf_dir)
    found = registry()["skew"].detect({"tasks": tasks}, standins.thresholds(spark))
    on = {c: c for c in ("cluster", "query_id", "stage_id")}
    return telemetry.fetch_if_fired(found, ["skew"], tasks, on)


def operators_of_queued_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry()["not_the_querys_fault"].detect(
        {"query_info": standins.query_info(spark, sf_dir)}, standins.thresholds(spark))
    return telemetry.fetch_if_fired(
        found, ["not_the_querys_fault"], standins.operators(spark, sf_dir), {"cluster": "cluster", "query_id": "query_id"})


def query_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: getattr(standins, n)(spark, sf_dir) for n in ("query_info", "stages", "operators")}
    operators = F.transform("operators", lambda o: o.input_rows)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return telemetry.query_report(frames).select(
        "cluster", "query_id", C("part").cast("bigint").alias("part"), "state", "elapsed_ms", "queued_ms", "peak_memory",
        F.coalesce(F.size("stages"), F.lit(0)).cast("bigint").alias("stages"),
        F.coalesce(F.size("operators"), F.lit(0)).cast("bigint").alias("operators"),
        F.coalesce(total(operators), F.lit(0)).alias("operator_input_rows"),
    )


def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latest_snapshot(standins.event_snapshots(spark, sf_dir)).select(
        "cluster", "query_id", "snapshot_id", "document")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def _profile(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profiles.table_stats(standins.table(spark, sf_dir, name), name, exact=True)

    return run


def stale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded counts are those of the parts; measured ones those of the file listing."""
    recorded = standins.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), C("p_partkey").cast("string")).alias("table_id"), C("p_size").cast("bigint").alias("row_count"))
    measured = standins.table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("p"), C("l_partkey").cast("string")).alias("table_id")).agg(F.count(F.lit(1)).alias("row_count"))
    return profiles.stats_stale(recorded, measured, standins.thresholds(spark))


def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.partition_info(standins.table_files(spark, sf_dir)).withColumn(
        "avg_file_bytes", F.round("avg_file_bytes", 6))


def scan_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scan a range of months of a table; line items are the files of the months."""
    item, order = (standins.table(spark, sf_dir, n) for n in ("lineitem", "orders"))
    files = item.select(
        F.concat(F.lit("t"), (C("l_partkey") % 7).cast("string")).alias("table_id"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("part"),
        (F.floor("l_quantity") * 1048576).alias("bytes"))
    low = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint")
    scans = order.select(
        F.concat(F.lit("q"), C("o_orderkey").cast("string")).alias("scan_id"),
        F.concat(F.lit("t"), (C("o_custkey") % 8).cast("string")).alias("table_id"),
        low.alias("low"), (low + C("o_orderkey") % 5).alias("high"))
    limit = spark.createDataFrame(
        [("estimate_scan", None, "scan_bytes", 5.0 * 1024 ** 3)], "detector string, fleet string, name string, value double")
    columns = scans.select("scan_id", "table_id", F.explode(F.array(F.lit("col7"), F.lit("col14"), F.lit("col15"))).alias("column_name"))
    shares = scan_estimate.column_share(standins.column_stats(spark, sf_dir), columns)
    return scan_estimate.estimate_scan(scans, files, limit, shares).select(
        "scan_id", "table_id", "partitions", "estimated_scan_bytes",
        F.round("estimated_cost", 3).alias("estimated_cost"), "safe_to_run",
        F.array_join("warnings", "; ").alias("warnings"))


_T, _D, _I = oracle.TELEMETRY, oracle.DETECTED, oracle.DETECTOR_INPUTS
_ALL_INPUTS = sorted({i for names in _I.values() for i in names})
_UNION = " union all ".join(f"({_D[name]})" for name in registry())
_RANK = ("case when rule_id = 'not_the_querys_fault' then 0 when severity = 'high' then 1 "
         "when severity = 'medium' then 2 else 3 end")
_HAS = {"no_partition_pruning": "scans", "exploding_join": "operators", "bad_broadcast": "operators",
        "missing_stats": "scans", "skew": "tasks", "small_files": "scan_files", "spilling": "operators",
        "not_the_querys_fault": "query_info", "ineffective_dynamic_filter": "dynamic_filters"}


def _detector_list(present: bool) -> str:
    flag = "" if present else "not "
    return "concat_ws(',', " + ", ".join(
        f"case when {flag}coalesce(has_{t}, false) then '{n}' end" for n, t in _HAS.items()) + ")"


def _reports_sql() -> str:
    sources = " union all ".join(
        f"select cluster, query_id, '{t}' as input, {'state' if t == 'query_info' else 'null'} as state from {t}"
        for t in sorted(set(_HAS.values())))
    flags = ", ".join(f"max(input = '{t}') as has_{t}" for t in sorted(set(_HAS.values())))
    return oracle.with_ctes(_T, _ALL_INPUTS, f"""
        , findings as ({_UNION})
        , per_query as (select cluster, query_id, count(*) as n,
              min_by(rule_id, concat({_RANK}, rule_id)) as first_finding from findings group by all)
        , presence as (select cluster, query_id, max(state) as query_state, {flags} from ({sources}) group by cluster, query_id)
        select p.cluster, p.query_id, query_state, {_detector_list(True)} as detectors_run,
               {_detector_list(False)} as detectors_skipped, coalesce(n, 0) as finding_count, first_finding
        from presence p left join per_query f on p.cluster = f.cluster and p.query_id = f.query_id""")


# Both stages: what fired, the tables it asks for per query, and the second detectors over those only.
_FIRST = [n for n in registry() if n not in ("missing_stats", "no_partition_pruning")]
_SIGNALS = f"""
    , fired as ({" union all ".join(f"({_D[name]})" for name in _FIRST)})
    , signals as (select cluster, query_id, stage_id, table_id, rule_id as rule from fired
        union all select distinct cluster, query_id, null, table_id, predicate_class from scans where predicate_class <> 'other')
    , stat_scans as (select * from scans where (cluster, query_id) in
        (select cluster, query_id from signals where rule in ('exploding_join', 'bad_broadcast', 'spilling', 'skew')))
    , layout_scans as (select * from scans
        where (cluster, query_id) in (select cluster, query_id from signals where rule in ('spilling', 'ineffective_dynamic_filter'))
           or (cluster, query_id, table_id) in (select cluster, query_id, table_id from signals where rule in ('small_files', 'wrapped_predicate', 'no_predicate')))"""
_SECOND = [_D["missing_stats"].replace("from scans", "from stat_scans"), _D["no_partition_pruning"].replace("from scans", "from layout_scans")]
_BECAUSE = {"tasks": "('skew')", "column_stats": "('exploding_join', 'bad_broadcast', 'spilling', 'skew')",
            "table_files": "('small_files', 'spilling', 'ineffective_dynamic_filter', 'wrapped_predicate', 'no_predicate')"}
_READ_BY = {"tasks": "fired", "column_stats": "stat_scans", "table_files": "layout_scans"}
_JUDGED = {**_HAS, "missing_stats": "stat_scans", "no_partition_pruning": "layout_scans"}


def _followed_sql() -> str:
    each = " union all ".join(
        f"""select fleet, cluster, query_id, '{detail}' as detail, string_agg(distinct rule, ',' order by rule) as because
            from (select concat('f', cast(query_id[2:] as bigint) % 5) as fleet, * from signals)
            where rule in {rules} and (cluster, query_id) in (select cluster, query_id from {_READ_BY[detail]}) group by all"""
        for detail, rules in _BECAUSE.items())
    ran = "concat_ws(',', " + ", ".join(
        f"case when (cluster, query_id) in (select cluster, query_id from {t}) then '{n}' end" for n, t in _JUDGED.items()) + ")"
    return f"{_SIGNALS} select *, {ran} as detectors_run from ({each})"


_EVENT_SKEW = _D["skew"].replace("from tasks", "from event_tasks")


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    """``columns``: name and the SQL of one value's bytes."""
    return " union all ".join(
        f"select '{name}' as table_id, count(*) as row_count, '{c}' as column_name, count(distinct {c}) as ndv, "
        f"count(*) filter ({c} is null) as nulls, cast(coalesce(sum({size}), 0) as bigint) as size from {name}"
        for c, size in columns)


def _sized(text: str) -> list[tuple[str, str]]:
    widths = {"i": "4", "l": "8", "d": "8", "t": "8"}
    pairs = [item.split(":") for item in text.split()]
    return [(c, f"strlen({c})" if k == "s" else f"len({c}) * 4" if k == "a" else widths[k]) for c, k in pairs]


COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:l s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d "
                "l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:l ts:t user_id:l event_type:s value:d props:s",
    "documents": "doc_id:l text:s lang:s source:s n_chars:l",
    "embeddings": "vec_id:l embedding:a label:i",
    "pages": "page_id:l url:s html:s",
    "benchmark": "item_id:l text:s",
    "labels": "doc_id:l quality:i toxic:i",
    "conversations": "conv_id:l turn:l role:s text:s",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"detect_{name}": _detector(name) for name in registry()},
    "detect_skew_of_hot_stages": skew_of_hot_stages,
    "all_findings": all_findings,
    "query_reports": query_reports,
    "analyze_with_details": two_stages,
    "followed_details": followed_details,
    "fetched_tasks": fetched_tasks,
    "finding_counts": finding_counts,
    "rank_findings": ranked_findings,
    "with_thresholds": thresholds_attached,
    "query_lookup": query_lookup,
    "classify_predicate": predicate_classes,
    "join_fanout": fanout_of_raw_tables,
    "tasks_of_skewed_stages": tasks_of_skewed_stages,
    "operators_of_queued_queries": operators_of_queued_queries,
    "query_report": query_report,
    "latest_snapshot": latest_snapshots,
    **{f"table_stats_{name}": _profile(name) for name in TABLES},
    "stats_stale": stale_stats,
    "partition_info": partition_layout,
    "estimate_scan": scan_estimates,
}

ORACLES: dict[str, str] = {
    **{f"detect_{name}": oracle.with_ctes(_T, _I[name], _D[name]) for name in registry()},
    "detect_skew_of_hot_stages": oracle.with_ctes(_T, ["event_tasks"], _EVENT_SKEW),
    "all_findings": oracle.with_ctes(_T, _ALL_INPUTS, _UNION),
    "query_reports": _reports_sql(),
    "analyze_with_details": oracle.with_ctes(_T, _ALL_INPUTS, f"{_SIGNALS} select * from fired union all " + " union all ".join(f"({sql})" for sql in _SECOND)),
    "followed_details": oracle.with_ctes(_T, _ALL_INPUTS, _followed_sql()),
    "fetched_tasks": oracle.with_ctes(_T, ["tasks"], f"""
        select t.* from tasks t semi join ({_D['skew']}) f on t.cluster = f.cluster and t.query_id = f.query_id and t.stage_id = f.stage_id"""),
    "finding_counts": oracle.with_ctes(_T, _ALL_INPUTS, f"""
        select fleet, cluster, rule_id, count(*) as findings, grouping_id(fleet, cluster, rule_id) as level
        from ({_UNION}) group by rollup (fleet, cluster, rule_id)"""),
    "rank_findings": oracle.with_ctes(_T, _ALL_INPUTS, f"""
        select cast({_RANK} as bigint) as rank, rule_id, cluster, query_id, severity from ({_UNION})"""),
    "with_thresholds": oracle.with_ctes(_T, ["query_info"], """
        select fleet, cluster, query_id, cast(case when fleet = 'f3' then 0.7 else 0.5 end as double) as threshold
        from query_info"""),
    "query_lookup": oracle.with_ctes(_T, ["operators"], "select * from operators where cluster = 'c7' and query_id = 'q1007'"),
    "classify_predicate": oracle.with_ctes(_T, ["scans"], """
        select table_id, predicate_class, count(*) as scans from scans group by all"""),
    "join_fanout": """
        select user_id, l as left_rows, r as right_rows, l * r as output_rows, round(l * r / (l + r), 6) as ratio from
          (select user_id, count(*) as l from events where event_type = 'click' group by all)
          join (select user_id, count(*) as r from events where event_type = 'view' group by all) using (user_id)
        where l * r / (l + r) > 3""",
    "tasks_of_skewed_stages": oracle.with_ctes(_T, ["event_tasks"], f"""
        select t.* from event_tasks t semi join ({_EVENT_SKEW}) f
          on t.cluster = f.cluster and t.query_id = f.query_id and t.stage_id = f.stage_id"""),
    "operators_of_queued_queries": oracle.with_ctes(_T, ["query_info", "operators"], f"""
        select o.* from operators o semi join ({_D['not_the_querys_fault']}) f
          on o.cluster = f.cluster and o.query_id = f.query_id"""),
    "query_report": oracle.with_ctes(_T, ["query_info", "operators"], """
        select q.cluster, q.query_id, cast(0 as bigint) as part, state, elapsed_ms, queued_ms, peak_memory,
               coalesce(s, 0) as stages, coalesce(n, 0) as operators, coalesce(r, 0) as operator_input_rows
        from query_info q left join (select cluster, query_id, count(distinct stage_id) as s, count(*) as n,
               cast(sum(input_rows) as bigint) as r from operators group by all) o using (cluster, query_id)"""),
    "latest_snapshot": """
        select concat('c', user_id % 25) as cluster, concat('q', user_id) as query_id, event_id as snapshot_id,
               props as document
        from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    **{f"table_stats_{name}": _profile_sql(name, _sized(COLUMNS[name])) for name in TABLES},
    "stats_stale": """
        select concat('p', p_partkey) as table_id, cast(p_size as bigint) as recorded_rows, n as measured_rows,
               abs(p_size - n) > 0.1 * greatest(n, 1) as stats_stale
        from part join (select l_partkey, count(*) as n from lineitem group by all) on l_partkey = p_partkey""",
    "partition_info": oracle.with_ctes(_T, ["table_files"], """
        select table_id, count(distinct part) as partition_count, count(*) as files,
               round(sum(bytes) / count(*), 6) as avg_file_bytes, mode(format) as format from table_files group by table_id"""),
    "estimate_scan": f"""
        with files as (select concat('t', l_partkey % 7) as table_id,
               cast(year(l_shipdate) * 12 + month(l_shipdate) as bigint) as part,
               sum(cast(floor(l_quantity) as bigint) * 1048576) as bytes from lineitem group by all),
        scans as (select concat('q', o_orderkey) as scan_id, concat('t', o_custkey % 8) as table_id,
               year(o_orderdate) * 12 + month(o_orderdate) as low,
               year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 5 as high from orders),
        column_stats as ({_T['column_stats']}),
        shares as (select table_id, sum(size) filter (column_name in ('col7', 'col14', 'col15')) / sum(size) as share
               from column_stats group by all having count(*) filter (column_name in ('col7', 'col14', 'col15')) > 0),
        listed as (select distinct table_id from files),
        sized as (select scan_id, s.table_id, count(part) as partitions, cast(coalesce(sum(bytes), 0) as bigint) as bytes
               from scans s left join files f on s.table_id = f.table_id and part between low and high group by all)
        select scan_id, z.table_id, partitions, bytes as estimated_scan_bytes,
               round(bytes * coalesce(share, 1.0), 3) as estimated_cost,
               bytes <= 5368709120 and l.table_id is not null as safe_to_run,
               concat_ws('; ', case when bytes > 5368709120 then concat('reads ', {oracle.human_bytes('bytes')}, ', limit 5GB') end,
                 case when l.table_id is null then 'no file listing for the table' end,
                 case when l.table_id is not null and partitions = 0 then 'no partition in range' end,
                 case when share is null then 'column sizes unknown, all columns assumed' end) as warnings
        from sized z left join shares h on z.table_id = h.table_id left join listed l on z.table_id = l.table_id""",
}
