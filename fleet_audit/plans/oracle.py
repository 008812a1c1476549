"""Pieces of plain SQL used to state the expected result of each registered query."""

from __future__ import annotations

_UNITS = (("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10))

BRIEF = ("fleet", "cluster", "rule_id", "severity", "property", "actual", "expected",
         "query_id", "stage_id", "operator_id", "table_id", "metric", "value", "threshold", "cause")


def plain_number(x: str) -> str:
    h = f"cast(floor(({x}) * 100 + 0.5) as bigint)"
    text = (f"concat(case when {h} < 0 then '-' else '' end, cast(abs({h}) // 100 as varchar), '.', "
            f"lpad(cast(abs({h}) % 100 as varchar), 2, '0'))")
    return f"regexp_replace({text}, '\\.?0+$', '')"


def human_bytes(x: str) -> str:
    number = f"cast({x} as double)"
    cases = " ".join(
        f"when {number} >= {2 ** power} then concat({plain_number(f'{number} / {2 ** power}.0')}, '{unit}')"
        for unit, power in _UNITS
    )
    return f"case {cases} else concat({plain_number(number)}, 'B') end"


def ratio_text(x: str) -> str:
    return f"concat({plain_number(x)}, 'x')"


def finding(source: str, **columns: str) -> str:
    """``select`` of the brief finding columns; those not given are NULL text or number."""
    unknown = set(columns) - set(BRIEF)
    if unknown:
        raise ValueError(sorted(unknown))

    def one(name: str) -> str:
        if name in ("value", "threshold"):
            return f"round(cast({columns.get(name, 'null')} as double), 6) as {name}"
        return f"cast({columns.get(name, 'null')} as varchar) as {name}"

    return f"select {', '.join(one(name) for name in BRIEF)} from {source}"


def with_ctes(ctes: dict[str, str], names: list[str], body: str) -> str:
    return "with " + ", ".join(f"{n} as ({ctes[n]})" for n in names) + " " + body


def keys(order: str) -> str:
    return (f"concat('f', {order} % 5) as fleet, concat('c', {order} % 25) as cluster, "
            f"concat('q', {order}) as query_id")


#: The stand-in inputs in plain SQL.
TELEMETRY = {
    "query_info": f"""select {keys('o_orderkey')},
        case o_orderstatus when 'F' then 'FINISHED' when 'O' then 'RUNNING' else 'FAILED' end as state,
        cast(floor(o_totalprice) as bigint) as elapsed_ms,
        cast(floor(o_totalprice * (o_orderkey % 10) / 10) as bigint) as queued_ms,
        cast(floor(o_totalprice * 7) as bigint) as peak_memory from orders""",
    "operators": f"""select {keys('l_orderkey')}, concat('s', l_linenumber % 2) as stage_id,
        concat('op', l_linenumber) as operator_id,
        case l_returnflag when 'A' then 'join' when 'N' then 'scan' else 'exchange' end as operator,
        cast(floor(l_quantity) as bigint) as input_rows,
        cast(floor(l_extendedprice / 100) as bigint) as output_rows,
        l_suppkey * 1048576 as build_bytes,
        case when l_discount >= 0.1 then cast(floor(l_extendedprice) as bigint) else 0 end as spilled_bytes
        from lineitem""",
    "tasks": f"""select {keys('l_orderkey')}, concat('s', l_linenumber % 2) as stage_id,
        concat('t', l_linenumber) as task_id, l_extendedprice as wall_ms
        from lineitem""",
    "event_tasks": """select concat('f', user_id % 5) as fleet, concat('c', user_id % 25) as cluster,
        concat('q', user_id % 10) as query_id, concat('s', user_id) as stage_id,
        concat('t', event_id) as task_id, value as wall_ms from events""",
    "scans": f"""select {keys('l_orderkey')}, concat('t', l_partkey % 7) as table_id,
        cast(l_linenumber % 2 as bigint) as part, 'ds' as partition_column,
        case when l_returnflag = 'A' then 'wrapped_predicate' when l_returnflag = 'N' then 'wrapped_predicate'
             when l_linestatus = 'O' then 'other' else 'no_predicate' end as predicate_class from lineitem""",
    "scan_files": f"""select {keys('l_orderkey')}, concat('t', l_partkey % 7) as table_id,
        concat('f', l_linenumber) as file_id, cast(floor(l_quantity) as bigint) * 1048576 as bytes from lineitem""",
    "table_files": """select concat('t', l_partkey % 7) as table_id, cast(l_linenumber % 2 as bigint) as part,
        case when l_returnflag = 'A' then 'PARQUET' else 'ORC' end as format,
        cast(floor(l_quantity) as bigint) * 1048576 as bytes from lineitem""",
    "column_stats": """select concat('t', p_partkey % 7) as table_id, concat('col', p_partkey) as column_name,
        nullif(p_size, 1) as ndv, cast(floor(p_retailprice) as bigint) as size,
        case when p_partkey % 7 <> 2 then 1000 end as row_count from part""",
    "dynamic_filters": f"""select {keys('o_orderkey')}, concat('df', o_custkey % 3) as filter_id,
        cast(floor(o_totalprice) as bigint) as input_rows,
        cast(floor(o_totalprice * (o_custkey % 21) / 20) as bigint) as output_rows
        from orders""",
}

#: Findings of each detector over those inputs.
DETECTED = {
    "no_partition_pruning": finding(
        """(select s.*, t.total, scanned / t.total as ratio from
              (select fleet, cluster, query_id, table_id, count(distinct part) as scanned,
                      max(case when predicate_class = 'wrapped_predicate' then 1 end) as wrapped,
                      max(case when predicate_class <> 'no_predicate' then 1 end) as predicated
               from scans group by all) s
            join (select table_id, count(distinct part) as total from table_files group by all) t
              on s.table_id = t.table_id and t.total > 1) where ratio >= 0.9""",
        fleet="fleet", cluster="cluster", rule_id="'no_partition_pruning'", severity="'high'",
        property="'partitions scanned'", actual="concat(scanned, ' of ', total)",
        expected="'below 90% of the partitions'", query_id="query_id", table_id="table_id",
        metric="'scanned_ratio'", value="ratio", threshold="0.9",
        cause="case when wrapped = 1 then 'wrapped_predicate' when predicated = 1 then 'other' else 'no_predicate' end"),
    "exploding_join": finding(
        """(select *, output_rows / input_rows as ratio, case when fleet = 'f1' then 40.0 else 15.0 end as t
            from operators where operator = 'join' and input_rows > 0) where ratio > t""",
        fleet="fleet", cluster="cluster", rule_id="'exploding_join'", severity="'high'",
        property="'join output rows'", actual=ratio_text("ratio"),
        expected="concat('at most ', case when fleet = 'f1' then '40x' else '15x' end, ' the input rows')",
        query_id="query_id", stage_id="stage_id", operator_id="operator_id",
        metric="'output_ratio'", value="ratio", threshold="t"),
    "bad_broadcast": finding(
        """(select fleet, cluster, query_id, stage_id, operator_id, max(build_bytes) as bytes
            from operators where operator = 'join' group by all) where bytes > 94371840""",
        fleet="fleet", cluster="cluster", rule_id="'bad_broadcast'", severity="'high'",
        property="'broadcast side input'", actual=human_bytes("bytes"), expected="'at most 90MB'",
        query_id="query_id", stage_id="stage_id", operator_id="operator_id",
        metric="'build_bytes'", value="bytes", threshold="94371840"),
    "missing_stats": finding(
        """(select distinct fleet, cluster, query_id, table_id from scans) s join
           (select table_id as t, count(*) filter (ndv is null) as missing, max(row_count) is null as no_rows,
                   min(case when ndv is null then column_name end) as first_column
            from column_stats group by table_id) m on s.table_id = m.t and (missing > 0 or no_rows)""",
        fleet="fleet", cluster="cluster", rule_id="'missing_stats'", severity="'medium'",
        property="'table statistics'",
        actual="concat(case when no_rows then 'no row count, ' else '' end, missing, ' columns without NDV')",
        expected="'row count and NDV of every column'", query_id="query_id", table_id="table_id",
        metric="'missing_columns'", value="missing", threshold="0", cause="coalesce(first_column, 'row_count')"),
    "skew": finding(
        """(select fleet, cluster, query_id, stage_id, max(wall_ms) / quantile_cont(wall_ms, 0.5) as ratio,
                   case when fleet = 'f1' then 8.0 else 5.0 end as t
            from tasks group by all having quantile_cont(wall_ms, 0.5) > 0) where ratio > t""",
        fleet="fleet", cluster="cluster", rule_id="'skew'", severity="'medium'", property="'task wall time'",
        actual=ratio_text("ratio"),
        expected="concat('at most ', case when fleet = 'f1' then '8x' else '5x' end, ' the median')",
        query_id="query_id", stage_id="stage_id", metric="'max_over_median'", value="ratio", threshold="t"),
    "small_files": finding(
        """(select fleet, cluster, query_id, table_id, sum(bytes) / count(file_id) as average,
                   count(file_id) as files,
                   case when fleet = 'f2' then 20971520 else 16777216 end as t
            from scan_files group by all) where average < t""",
        fleet="fleet", cluster="cluster", rule_id="'small_files'", severity="'medium'",
        property="'average file size'", actual=f"concat({human_bytes('average')}, ' over ', files, ' files')",
        expected="concat('at least ', case when fleet = 'f2' then '20MB' else '16MB' end)",
        query_id="query_id", table_id="table_id", metric="'average_bytes'", value="average", threshold="t"),
    "spilling": finding(
        "(select fleet, cluster, query_id, sum(spilled_bytes) as bytes from operators group by all) where bytes > 0",
        fleet="fleet", cluster="cluster", rule_id="'spilling'", severity="'medium'", property="'spilled bytes'",
        actual=human_bytes("bytes"), expected="'at most 0B'", query_id="query_id",
        metric="'spilled_bytes'", value="bytes", threshold="0"),
    "not_the_querys_fault": finding(
        """(select *, queued_ms / elapsed_ms as ratio, case when fleet = 'f3' then 0.7 else 0.5 end as t
            from query_info where elapsed_ms > 0 and queued_ms > 0) where ratio > t""",
        fleet="fleet", cluster="cluster", rule_id="'not_the_querys_fault'", severity="'high'",
        property="'queued time'", actual="concat(queued_ms, 'ms of ', elapsed_ms, 'ms')",
        expected="concat('at most ', case when fleet = 'f3' then '70' else '50' end, '% of elapsed')",
        query_id="query_id", metric="'queued_ratio'", value="ratio", threshold="t", cause="'cluster_contention'"),
    "ineffective_dynamic_filter": finding(
        """(select *, (input_rows - output_rows) / input_rows as reduction from dynamic_filters
            where input_rows > 0) where reduction < 0.1""",
        fleet="fleet", cluster="cluster", rule_id="'ineffective_dynamic_filter'", severity="'low'",
        property="'dynamic filter reduction'", actual=f"concat({plain_number('reduction * 100')}, '%')",
        expected="'at least 10%'", query_id="query_id", operator_id="filter_id",
        metric="'reduction'", value="reduction", threshold="0.1"),
}

#: Stand-in inputs each detector reads, for the CTE list.
DETECTOR_INPUTS = {
    "no_partition_pruning": ["scans", "table_files"], "exploding_join": ["operators"],
    "bad_broadcast": ["operators"], "missing_stats": ["scans", "column_stats"], "skew": ["tasks"],
    "small_files": ["scan_files"], "spilling": ["operators"], "not_the_querys_fault": ["query_info"],
    "ineffective_dynamic_filter": ["dynamic_filters"],
}
