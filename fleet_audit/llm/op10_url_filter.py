"""The registered query of :mod:`fleet_audit.llm.url_filter`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleet_audit.llm.shared import table
from fleet_audit.llm.url_filter import Rule, judge_urls

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op10_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES)


def _rule_sql(host: str, path: str, field: str) -> str:
    cases = " ".join(
        f"when ({host} = '{r.host}' or ends_with({host}, '.{r.host}')) and starts_with({path}, '{r.path}') then '{getattr(r, field)}'"
        for r in sorted(RULES, key=lambda r: (-len(r.name), r.action))
    )
    return f"case {cases} end"


_HOST = r"coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_NODE = (
    "case when " + _HOST + r" <> '' then lower(regexp_extract({0}, '(?s)^(.*?)://', 1)) || '://' || " + _HOST
    + r" || regexp_replace(regexp_replace({0}, '(?s)^.*?://[^/?#]*', ''), '(?s)#.*$', '') end"
)
#: Absolute links only: the given pages have no others.
op10_sql = f"""
with recursive tags as (
    select url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) tag, 'href' kind from pages
    union all select url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')) tag, 'refresh' kind from pages),
links as (
    select url, replace(case when kind = 'href' and regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b')
        then regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
        when kind = 'refresh' and regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
        then regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?[^"''>]*?\\burl\\s*=\\s*''?([^"''\\s>]+)', 1) end, '&amp;', '&') link from tags),
edges as (select distinct {_NODE.format('url')} a, {_NODE.format('link')} b from links where link <> ''),
both_ways as (select a, b from edges union select b, a from edges),
reach as (select a node, a other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
blocked as (select distinct node from reach
    where {_rule_sql(_HOST.format('other'), _PATH.format('other'), 'action')} = 'block'),
judged as (select page_id, {_HOST.format('url')} host, {_PATH.format('url')} path, {_NODE.format('url')} node from pages)
select page_id, host, path, {_rule_sql('host', 'path', 'name')} "rule",
    coalesce({_rule_sql('host', 'path', 'action')}, case when blocked.node is not null then 'block' else 'allow' end) verdict,
    blocked.node is not null blocked_alias
from judged left join blocked using (node)
"""
