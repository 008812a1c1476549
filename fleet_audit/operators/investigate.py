"""Analysis in two stages: what a query document shows decides which details are looked up next.

Stage one runs the detectors that need nothing but the documents, over all queries. Rows of :data:`FOLLOW_UPS` say which detail
to fetch for what fired, and for scans whose predicate cannot prune. Stage two reads of each detail only what these queries ask for
and runs the detectors that judge it. No model and no person decides in between: the branching is data.

What fired is written once and counted, so that a detail nobody asks for is not read at all, a few keys are broadcast to where
the detail lies, and many are joined by key. ``analyze_queries`` is the same without the branching: it judges all
queries by all tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import all_findings
from fleet_audit.fixed_values import FOLLOW_UPS
from fleet_audit.functions.bounds import broadcast_if_small
from fleet_audit.operators.detectors import Detector, registry
from fleet_audit.operators.predicates import classify_predicate
from fleet_audit.operators.references import REFERENCES, table_keys
from fleet_audit.operators.report import detector_coverage, runnable
from fleet_audit.operators.thresholds import Thresholds
from fleet_audit.sources.stores import materialize

_QUERY = ["cluster", "query_id"]
_READ = ["fleet", *_QUERY, "table_id"]


@dataclass(frozen=True)
class Investigation:
    """``findings`` of both stages; ``followed`` (``fleet, cluster, query_id, detail, because``); the fetched rows of each detail; and ``coverage``."""

    findings: DataFrame
    followed: DataFrame
    details: dict[str, DataFrame]
    coverage: DataFrame


def signals(first: DataFrame, scans: DataFrame | None) -> DataFrame:
    """``fleet, cluster, query_id, stage_id, table_id, rule``: what fired, and predicates that cannot prune. Null ids say "all of the query"."""
    fired = first.select(
        "fleet", "cluster", F.col("evidence.query_id").alias("query_id"), F.col("evidence.stage_id").alias("stage_id"),
        F.col("evidence.table").alias("table_id"), F.col("rule_id").alias("rule"))
    if scans is None:
        return fired
    loose = classify_predicate(scans).where(F.col("predicate_class").isin("wrapped_predicate", "no_predicate"))
    loose = loose.select(*_READ, F.col("predicate_class").alias("rule")).distinct()
    return fired.unionByName(loose, allowMissingColumns=True)


def _asked(seen: DataFrame, follow_ups: Mapping[str, tuple[str, ...]], detail: str) -> DataFrame:
    return seen.where(F.col("rule").isin(list(follow_ups.get(detail, ()))))


def reads_of(seen: DataFrame, read: DataFrame) -> DataFrame:
    """Which tables to look up for which queries: those a signal names, or else all that the query scans. ``read`` has a row per query and table."""
    whole = broadcast_if_small(seen.where("table_id is null").select(*_QUERY).distinct()).withColumn("_whole", F.lit(True))
    named = broadcast_if_small(seen.where("table_id is not null").select(*_QUERY, "table_id").distinct()).withColumn("_named", F.lit(True))
    met = read.join(whole, _QUERY, "left").join(named, [*_QUERY, "table_id"], "left")
    return met.where("_whole or _named").select(*_READ)


def fetch(detail: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``detail`` that ``wanted`` (a written table) asks for; not read when it asks for none."""
    some = wanted.select(*keys).distinct()
    return detail.limit(0) if wanted.isEmpty() else detail.join(broadcast_if_small(some), keys, "left_semi")


def analyze_with_details(
    tables: Mapping[str, DataFrame],
    thresholds: DataFrame | Thresholds,
    detectors: Mapping[str, Detector] | None = None,
    follow_ups: Mapping[str, tuple[str, ...]] = FOLLOW_UPS,
) -> Investigation:
    """Both stages over every query at once.

    ``tables`` holds the flat tables of the documents and any of the details ``column_stats`` and ``table_files``; the tasks
    of the documents are a detail, too. A detector of stage two judges the queries that asked for its detail.
    """
    limits, chosen = Thresholds.of(thresholds), runnable(tables, detectors)
    at_first = {n: d for n, d in chosen.items() if not d.references}
    if not at_first:
        raise ValueError("no detector of the first stage has its input tables")
    first = materialize(all_findings(*[d.detect(tables, limits) for d in at_first.values()]))
    scans = tables.get("scans")
    seen = materialize(signals(first, scans))

    details: dict[str, DataFrame] = {}
    reads: dict[str, DataFrame] = {}
    found, followed = [first], []
    # Read once for all references.
    read = None if scans is None or not set(REFERENCES) & set(tables) else materialize(scans.select(*_READ).distinct())
    if "tasks" in tables:
        stages = _asked(seen, follow_ups, "tasks").where("stage_id is not null")
        details["tasks"] = fetch(tables["tasks"], stages, [*_QUERY, "stage_id"])
        followed.append(stages.select("fleet", *_QUERY, F.lit("tasks").alias("detail"), "rule"))
    for name in REFERENCES:
        if name not in tables or read is None:
            continue
        asked = _asked(seen, follow_ups, name)
        reads[name] = materialize(reads_of(asked, read))
        details[name] = fetch(tables[name], reads[name], table_keys(tables[name]))
        looked_up = reads[name].select(*_QUERY).distinct()
        followed.append(asked.join(looked_up, _QUERY, "left_semi").select("fleet", *_QUERY, F.lit(name).alias("detail"), "rule"))
    for detector in chosen.values():
        if detector.references and all(r in reads for r in detector.references):
            # A detector with several details judges what asked for all of them.
            narrowed = reduce(lambda frame, r: frame.join(reads[r].select(*_QUERY, "table_id"), [*_QUERY, "table_id"], "left_semi"), detector.references, scans)
            found.append(detector.detect({**tables, **details, "scans": narrowed}, limits))
    because = None
    if followed:
        because = reduce(DataFrame.unionByName, followed).groupBy("fleet", *_QUERY, "detail").agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("because"))
    else:
        because = seen.limit(0).select("fleet", *_QUERY, F.lit("").alias("detail"), F.lit("").alias("because"))
    coverage = detector_coverage({**tables, **{r: details[r] for r in reads}}, detectors or registry(), reads)
    return Investigation(all_findings(*found), because, details, coverage)
