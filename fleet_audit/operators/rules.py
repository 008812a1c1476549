"""Evaluate the rule catalogue on every entry of every cluster.

Nothing here takes guidance from outside: findings come from rules and entries alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import all_findings, to_findings
from fleet_audit.functions.bounds import bounded_rows
from fleet_audit.functions.checks import typed_check, validate_catalogue
from fleet_audit.functions.text import human_bytes, plain_number
from fleet_audit.functions.versions import version_in_gate
from fleet_audit.operators.normalize import rules_in_scope
from fleet_audit.operators.redaction import shown_value
from fleet_audit.schemas import FINDINGS
from fleet_audit.sources.parsers import JVM_FILES

#: Distinct checks compiled into one projection; a larger catalogue takes more passes.
CHECKS_PER_PASS = 200

_TEMPLATE = r"^\s*value\s*(<=|>=|<|>|=)\s*(\d+(?:\.\d+)?)\s*\*\s*(jvm_heap|total_heap|total_nodes)\s*$"
_PLAIN = r"^\s*(?:value|text)\s*(<=|>=|<|>|=)\s*(\d+(?:\.\d+)?|'[^']*')\s*$"


def node_facts(entries: DataFrame) -> DataFrame:
    """``cluster, role, node, jvm_heap``; the last ``-Xmx`` of a node counts."""
    return (
        entries.where(F.col("file").rlike(JVM_FILES) & (F.col("key") == "-Xmx") & F.col("num").isNotNull())
        .groupBy("cluster", "role", "node")
        .agg(F.max_by("num", "line").alias("jvm_heap"))
    )


def _with_facts(hits: DataFrame, entries: DataFrame, names: set[str]) -> DataFrame:
    """Join the node and role facts that the checks of this pass mention."""
    facts = node_facts(entries)
    if "jvm_heap" in names:
        hits = hits.join(facts, ["cluster", "role", "node"], "left")
    if names & {"total_heap", "total_nodes"}:
        totals = facts.groupBy("cluster", "role").agg(
            F.sum("jvm_heap").cast("decimal(38,6)").alias("total_heap"),
            F.count(F.lit(1)).alias("total_nodes"),
        )
        hits = hits.join(totals, ["cluster", "role"], "left")
    missing = {"jvm_heap", "total_heap", "total_nodes"} - set(hits.columns)
    return hits.withColumns({n: F.lit(None).cast("decimal(38,6)") for n in missing})


def _expected(check: Column) -> Column:
    """The limit in words: ``<= 24GB (30% of 80GB heap)``; else the check itself."""
    operator, factor, name = (F.regexp_extract(check, _TEMPLATE, i) for i in (1, 2, 3))
    base = (
        F.when(name == "jvm_heap", F.col("jvm_heap"))
        .when(name == "total_heap", F.col("total_heap"))
        .otherwise(F.col("total_nodes").cast("decimal(38,6)"))
    )
    share = factor.try_cast("double")
    is_size = name != "total_nodes"
    shown = lambda v: F.when(is_size, human_bytes(v)).otherwise(plain_number(v.cast("double")))
    word = F.when(name == "jvm_heap", " heap").when(name == "total_heap", " total heap").otherwise(" nodes")
    in_words = F.concat(
        operator, F.lit(" "), shown(base.cast("double") * share),
        F.lit(" ("), plain_number(share * 100), F.lit("% of "), shown(base), word, F.lit(")"),
    )
    plain = F.concat(F.regexp_extract(check, _PLAIN, 1), F.lit(" "),
                     F.translate(F.regexp_extract(check, _PLAIN, 2), "'", ""))
    return F.when(check.rlike(_TEMPLATE), in_words).when(check.rlike(_PLAIN), plain).otherwise(check)


def _matched(entries: DataFrame, rules: DataFrame, snapshot: DataFrame, rows: list) -> DataFrame:
    """Entries next to each rule that applies to them.

    The catalogue was counted before it got here, which makes its broadcast safe;
    the property list filters entries at the scan. Cluster versions are one row per
    cluster and join without adding rows.
    """
    catalogue = F.broadcast(
        rules.sparkSession.createDataFrame(rows, rules.schema).withColumnRenamed("role", "rule_role")
    )
    properties = sorted({r.property for r in rows})
    on = (F.col("key") == F.col("property")) & (
        F.col("rule_role").isNull() | (F.col("rule_role") == F.col("role"))
    )
    versions = snapshot.select("cluster", "version")
    return (
        entries.where(F.col("key").isin(properties))
        .join(catalogue, on)
        .join(versions, "cluster", "left")
        .where(version_in_gate(F.col("version"), F.col("gates")))
    )


def entries_per_rule(entries: DataFrame, rules: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Entries next to the rules that apply to them by property, role and version."""
    return _matched(entries, rules, snapshot, bounded_rows(rules, "the rule catalogue"))


def _passes(rows: list) -> list[list]:
    checks = sorted({r.check for r in rows})
    groups = [set(checks[i:i + CHECKS_PER_PASS]) for i in range(0, len(checks), CHECKS_PER_PASS)]
    return [[r for r in rows if r.check in group] for group in groups]


def _outcomes(entries: DataFrame, rules: DataFrame, snapshot: DataFrame, scopes) -> list[DataFrame]:
    """Entries with rule and ``passed`` (true, false, or NULL when it cannot be told)."""
    rows = bounded_rows(rules_in_scope(rules, scopes), "the rule catalogue")
    used = validate_catalogue(rows)
    results = []
    for part in _passes(rows):
        checks = sorted({r.check for r in part})
        frame = _with_facts(
            _matched(entries, rules, snapshot, part), entries, set().union(*[used[c] for c in checks])
        ).withColumns({"value": F.col("num"), "text": F.col("raw")})
        passed = reduce(
            lambda chain, c: chain.when(F.col("check") == c, F.expr(typed_check(c))),
            checks[1:],
            F.when(F.col("check") == checks[0], F.expr(typed_check(checks[0]))),
        )
        results.append(frame.withColumn("passed", passed))
    return results


def run_rules(
    entries: DataFrame, rules: DataFrame, snapshot: DataFrame, scopes: list[str] | None = None
) -> DataFrame:
    """Findings of all single-property rules over normalized ``entries``.

    All checks are evaluated in one pass over the entries they apply to. A check whose
    inputs are absent is NULL and does not fire; see :func:`unevaluable_rules`.
    """
    found = [
        to_findings(
            frame.where("not passed"),
            cluster=F.col("cluster"), rule_id=F.col("rule_id"), severity=F.col("severity"),
            property=F.col("property"), actual=shown_value(), expected=_expected(F.col("check")),
            rationale=F.col("rationale"),
            doc_ref={"source": F.col("doc_source"), "version": F.col("doc_version"),
                     "page": F.col("doc_page"), "anchor": F.col("property")},
            file=F.concat_ws("/", "role", "file"), line=F.col("line"),
            metric=F.lit("value"), value=F.col("num").cast("double"),
        )
        for frame in _outcomes(entries, rules, snapshot, scopes)
    ]
    if not found:
        return entries.sparkSession.createDataFrame([], FINDINGS)
    return all_findings(*found)


def unevaluable_rules(
    entries: DataFrame, rules: DataFrame, snapshot: DataFrame, scopes: list[str] | None = None
) -> DataFrame:
    """``cluster, rules_unevaluable``: applicable rules that could be told on no entry."""
    frames = [
        f.select("cluster", "rule_id", "passed") for f in _outcomes(entries, rules, snapshot, scopes)
    ]
    return (
        reduce(DataFrame.unionByName, frames)
        .groupBy("cluster", "rule_id")
        .agg(F.count("passed").alias("told"))
        .groupBy("cluster")
        .agg(F.count_if(F.col("told") == 0).alias("rules_unevaluable"))
    )
