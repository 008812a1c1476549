"""All detectors over all recorded queries, and one report row per query."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit.findings import all_findings
from fleet_audit.functions.bounds import broadcast_if_small
from fleet_audit.functions.nesting import ROWS_PER_PART, nest_rows
from fleet_audit.operators.detectors import Detector, registry
from fleet_audit.operators.detectors.not_the_querys_fault import NAME as QUEUED
from fleet_audit.operators.references import REFERENCES, table_keys
from fleet_audit.operators.thresholds import Thresholds

_QUERY = ["cluster", "query_id"]

#: Most different wordings of findings (what a rule always says) that are told by number while findings are exchanged.
MAX_WORDINGS = 1_000
_BEFORE, _BEHIND = ("rule_id", "severity", "property"), ("expected", "rationale", "rationale_source")


def runnable(tables: Mapping[str, DataFrame], detectors: Mapping[str, Detector] | None = None) -> dict[str, Detector]:
    """Detectors whose input tables are all present."""
    return {n: d for n, d in (detectors or registry()).items() if all(t in tables for t in d.inputs)}


def analyze_queries(
    tables: Mapping[str, DataFrame],
    thresholds: DataFrame | Thresholds,
    detectors: Mapping[str, Detector] | None = None,
) -> DataFrame:
    """Findings of every detector that has its inputs, over every query at once."""
    chosen = runnable(tables, detectors)
    if not chosen:
        raise ValueError("no detector has its input tables")
    limits = Thresholds.of(thresholds)
    return all_findings(*[d.detect(tables, limits) for d in chosen.values()])


def detector_coverage(
    tables: Mapping[str, DataFrame], detectors: Mapping[str, Detector] | None = None, reads: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """``cluster, query_id, query_state, detectors_run, detectors_skipped``.

    A detector has run for a query when every input of it has a row of that query. A reference table has one
    when it describes a table that the query scans; ``reads`` (``cluster, query_id, table_id`` per reference) narrows that to what was
    looked up. Each table is reduced to its queries before they meet in one aggregation.
    """
    chosen, known = runnable(tables, detectors), detectors or registry()
    inputs = sorted({i for d in chosen.values() for i in d.inputs})
    flags = [*inputs, *(f"{r}_asked" for r in inputs if r in REFERENCES)]
    bit = {name: 1 << place for place, name in enumerate(dict.fromkeys(["query_info", *flags]))}

    def marked(frame: DataFrame, always: list[str], found: list[str] = ()) -> DataFrame:
        """Queries of ``frame`` with the bits of ``always``, and of those references in ``found`` that describe the row's table."""
        bits = F.lit(sum(bit[n] for n in always)).cast("long")
        for name in found:
            keys = table_keys(tables[name])
            described = broadcast_if_small(tables[name].select(*keys).distinct())
            frame = frame.join(described.withColumn(f"_in_{name}", F.lit(bit[name])), keys, "left")
            bits = bits + F.coalesce(F.col(f"_in_{name}"), F.lit(0))
        return frame.select(*_QUERY, bits.alias("_bits"))

    known_tables = ({*inputs, "query_info"} & set(tables)) - set(REFERENCES)
    wide = [r for r in inputs if r in REFERENCES and r not in (reads or {})]
    rows = [marked(tables[name], [name]) for name in sorted(known_tables - ({"scans"} if wide else set()))]
    if wide:
        # Every reference is looked up for the same scans, which are read once.
        rows.append(marked(tables["scans"], [*({"scans"} & known_tables), *(f"{r}_asked" for r in wide)], wide))
    rows += [marked(reads[r], [f"{r}_asked"], [r]) for r in inputs if r in REFERENCES and r not in wide]
    # Bits are combined before texts come in, which only a sort can aggregate.
    seen = reduce(DataFrame.unionByName, rows).groupBy(*_QUERY).agg(F.bit_or("_bits").alias("_bits"), F.lit(None).cast("string").alias("state"))
    if "query_info" in tables:
        seen = seen.unionByName(tables["query_info"].select(*_QUERY, F.lit(0).cast("long").alias("_bits"), "state"))
    flags = seen.groupBy(*_QUERY).agg(F.max("state").alias("query_state"), F.bit_or("_bits").alias("_bits")).select(
        *_QUERY, "query_state", *[(F.col("_bits").bitwiseAND(bit[n]) != 0).alias(f"_has_{n}") for n in flags])

    def has(detector: Detector) -> Column:
        if detector.name not in chosen:
            return F.lit(False)
        needed = [f"_has_{i}_asked" if i in detector.absent_counts else f"_has_{i}" for i in detector.inputs]
        return reduce(Column.__and__, map(F.col, needed))

    run = F.array_compact(F.array(*[F.when(has(d), F.lit(d.name)) for d in known.values()]))
    skipped = F.array_compact(F.array(*[F.when(~has(d), F.lit(d.name)) for d in known.values()]))
    return flags.select(*_QUERY, "query_state", run.alias("detectors_run"), skipped.alias("detectors_skipped"))


def _nested_findings(findings: DataFrame, rows_per_part: int) -> DataFrame:
    """``cluster, query_id, part, parts, findings``, the findings in reading order.

    A rule says the same of every query, in few wordings. They are numbered in their order, so findings are exchanged and sorted with two
    numbers instead of these texts and without the query's own id, and get them back where they are nested.
    """
    rank, own_id = finding_rank().alias("rank"), lambda e, value: e.withField("query_id", value)
    rows = findings.select(rank, *_BEFORE, *_BEHIND).distinct().limit(MAX_WORDINGS + 1).collect()
    if not 0 < len(rows) <= MAX_WORDINGS:
        return nest_rows(findings, _QUERY, F.struct(rank, *_BEFORE, "actual", *_BEHIND, "evidence", "doc_ref"), "findings", rows_per_part)
    in_order = lambda texts: sorted(set(texts), key=lambda text: [(value is not None, value) for value in text])
    before, behind = in_order((r.rank, *(r[c] for c in _BEFORE)) for r in rows), in_order(tuple(r[c] for c in _BEHIND) for r in rows)
    wordings = findings.sparkSession.createDataFrame(
        [(before.index((r.rank, *(r[c] for c in _BEFORE))), behind.index(tuple(r[c] for c in _BEHIND)), *(r[c] for c in (*_BEFORE, *_BEHIND))) for r in rows],
        "_before int, _behind int, " + ", ".join(f"_of_{c} string" for c in (*_BEFORE, *_BEHIND)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*_BEFORE, *_BEHIND)])
    nothing = F.lit(None).cast("string")
    item = F.struct("_before", "actual", "_behind", own_id(F.col("evidence"), nothing).alias("evidence"), "doc_ref")
    nested = nest_rows(findings.join(F.broadcast(wordings), same), _QUERY, item, "findings", rows_per_part)

    def listed(texts: list[tuple], names: tuple[str, ...]) -> Column:
        return F.array(*[F.struct(*[F.lit(v).cast("int" if n == "rank" else "string").alias(n) for n, v in zip(names, text)]) for text in texts])

    heads, tails = listed(before, ("rank", *_BEFORE)), listed(behind, _BEHIND)

    def whole(found: Column) -> Column:
        head, tail = F.get(heads, found["_before"]), F.get(tails, found["_behind"])
        return F.struct(
            *[head[c].alias(c) for c in ("rank", *_BEFORE)], found["actual"].alias("actual"), *[tail[c].alias(c) for c in _BEHIND],
            own_id(found["evidence"], F.col("query_id")).alias("evidence"), found["doc_ref"].alias("doc_ref"))

    return nested.withColumn("findings", F.transform("findings", whole))


def query_reports(
    tables: Mapping[str, DataFrame],
    findings: DataFrame,
    detectors: Mapping[str, Detector] | None = None,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """One row per query: state, detectors run and skipped, and its findings, first things first.

    Give it findings that were written to a store: they are read twice, once to size
    the rows. Findings beyond ``rows_per_part`` continue in rows with a higher ``part``.
    """
    nested = _nested_findings(findings.withColumn("query_id", F.col("evidence.query_id")), rows_per_part)
    return (
        detector_coverage(tables, detectors)
        .join(nested, _QUERY, "left")
        .select(
            *_QUERY, "query_state", F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce("parts", F.lit(1)).alias("parts"),
            "findings", "detectors_run", "detectors_skipped",
        )
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per fleet, cluster and rule with all subtotals."""
    return findings.rollup("fleet", "cluster", "rule_id").agg(
        F.count(F.lit(1)).alias("findings"), F.grouping_id().alias("level")
    )


def finding_rank() -> Column:
    """Queueing first, as it clears the query; then by severity."""
    severity = F.col("severity")
    return (
        F.when(F.col("rule_id") == QUEUED, 0)
        .when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)
    )


def rank_findings(findings: DataFrame) -> DataFrame:
    """Findings in reading order, with the ``rank`` they were ordered by."""
    return findings.withColumn("rank", finding_rank()).orderBy(
        "rank", "rule_id", "cluster", "evidence.query_id", "property"
    )
