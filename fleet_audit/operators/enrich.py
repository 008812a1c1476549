"""Better reasons for findings that already fired, and notes on outside guidance.

Runs on finished findings only. Guidance sets no threshold, adds no finding and
suppresses none; where it disagrees with a rule, both are named in a note.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleet_audit.findings import to_notes
from fleet_audit.functions.text import limit_parts
from fleet_audit.functions.versions import gate_array, version_array, version_in_gate
from fleet_audit.sources.stores import materialize

#: Where a reason may come from, best first; the catalogue's own is always there.
RESOLUTION_ORDER = ("context_passage", "context_property", "local_index", "rule_catalog")

_PROPERTY_NAME = r"[a-z][a-z0-9_-]*(?:[.][a-z0-9_-]+)+"
_CHECK_LIMIT = r"^\s*value\s*(<=|>=|<|>|=)\s*(\d+(?:\.\d+)?)"


def best_rationale(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The first candidate of each key by ``priority``, ties by text.

    Spark limits each map task to one row per key before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy("priority", "text")
    return candidates.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def _guided(asked: DataFrame, context: DataFrame, kind: str, keys: list[str], output: str) -> DataFrame:
    """``asked`` with the text that the guidance of its cluster gives on ``keys``, or else guidance for all clusters."""
    given = context.where((F.col("kind") == kind) & F.col("text").isNotNull()).select("cluster", *keys, "text", F.lit(0).alias("priority"))
    best = best_rationale(given, ["cluster", *keys])
    own = best.where("cluster is not null").select("cluster", *keys, F.col("text").alias("_own"))
    general = best.where("cluster is null").select(*keys, F.col("text").alias("_all"))
    return asked.join(own, ["cluster", *keys], "left").join(general, keys, "left").withColumn(output, F.coalesce("_own", "_all")).drop("_own", "_all")


def _indexed(asked: DataFrame, passages: DataFrame, snapshot: DataFrame | None, output: str) -> DataFrame:
    """``asked`` with the text of the local index on its document and page that holds for the version of its cluster."""
    pages = ["doc", "page"]
    given = passages.where("text is not null").select(F.col("source_doc").alias("doc"), "page", "engine_version", "text", F.lit(0).alias("priority"))
    if snapshot is None:
        best = best_rationale(given, pages)
        return asked.join(best.select(*pages, F.col("text").alias(output)), pages, "left")
    versions = snapshot.groupBy("cluster").agg(F.max("engine_version").alias("_version"))
    asked = asked.join(versions, "cluster", "left").withColumn("_version", F.coalesce("_version", F.lit("")))
    # One question per version and page, and one answer per version range of a page.
    ranges = best_rationale(given, [*pages, "engine_version"])
    met = version_in_gate(version_array(F.col("_version")), gate_array(F.col("engine_version")))
    fitting = asked.select("_version", *pages).distinct().join(ranges, pages).where(met)
    best = best_rationale(fitting, ["_version", *pages])
    return asked.join(best.select("_version", *pages, F.col("text").alias(output)), ["_version", *pages], "left").drop("_version")


def enrich(
    findings: DataFrame, context: DataFrame | None = None, passages: DataFrame | None = None, snapshot: DataFrame | None = None
) -> DataFrame:
    """Resolve the rationale of each finding; rows, ids and order of columns stay.

    Order: a context passage for the finding's document and page, context guidance on
    its property, the local index, the catalogue. Guidance that names a cluster holds for this cluster only and comes before
    guidance for all; with ``snapshot`` a passage with a version gate is taken only where the cluster's version meets it.

    Findings are reduced to what they ask about (cluster, document, page, property) before anything is joined, and answers are one row
    per question, so a rule that fired everywhere is no hot key and no join adds rows. Findings are written once, since they are read
    for their questions and for the result.
    """
    if context is None and passages is None:
        return findings
    findings = materialize(findings)
    key = {"cluster": F.col("cluster"), "doc": F.col("doc_ref.source"), "page": F.col("doc_ref.page"), "property": F.col("property")}
    asked = findings.select(*[c.alias(n) for n, c in key.items()]).distinct()
    none = F.lit(None).cast("string")
    asked = _guided(asked, context, "passage", ["doc", "page"], "_said") if context is not None else asked.withColumn("_said", none)
    asked = _guided(asked, context, "property", ["property"], "_advised") if context is not None else asked.withColumn("_advised", none)
    asked = _indexed(asked, passages, snapshot, "_found") if passages is not None else asked.withColumn("_found", none)
    answers = ("_said", "_advised", "_found")
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for c, name in zip(answers, RESOLUTION_ORDER)])
    answered = asked.select(*[F.col(n).alias(f"_{n}") for n in key], F.coalesce(*answers).alias("_text"), source.alias("_source")).where("_source is not null")
    same = reduce(Column.__and__, [c.eqNullSafe(F.col(f"_{n}")) for n, c in key.items()])
    found = findings.join(answered, same, "left")
    return found.withColumns({
        "rationale": F.coalesce("_text", "rationale"), "rationale_source": F.coalesce("_source", "rationale_source")}).select(*findings.columns)


def annotate_uncovered(context: DataFrame, rules: DataFrame) -> DataFrame:
    """A note for guidance on a property that no rule covers."""
    guidance = context.where("kind = 'property'")
    uncovered = guidance.join(rules.select("property").distinct(), "property", "left_anti")
    return to_notes(
        uncovered, kind="unvalidated_guidance", cluster=F.col("cluster"), property=F.col("property"),
        text=F.col("text"), severity="low",
    )


def guidance_conflicts(context: DataFrame, rules: DataFrame) -> DataFrame:
    """A low-severity note where guidance states another limit than a rule does.

    A passage speaks of a property when it names it; names are taken out of the text
    and matched by value, so passages are not paired with all rules. A limit conflicts
    when its number, or its direction if both state one, differs.
    """
    named = context.where("kind = 'property'").select("cluster", "property", "text")
    passages = context.where("kind = 'passage'").select(
        "cluster",
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_PROPERTY_NAME), F.lit(0)))).alias("property"),
        "text",
    )
    limits = rules.select(
        "property", "rule_id", "check",
        F.regexp_extract("check", _CHECK_LIMIT, 1).alias("rule_sign"),
        F.regexp_extract("check", _CHECK_LIMIT, 2).try_cast("double").alias("rule_limit"),
    ).where("rule_limit is not null")
    sign, limit = limit_parts(F.replace(F.col("text"), F.col("property"), F.lit("")))
    stated = (
        named.unionByName(passages).withColumns({"said_sign": sign, "said_limit": limit})
        .where("said_limit is not null")
    )
    direction = lambda c: F.substring(c, 1, 1)
    conflict = (F.col("said_limit") != F.col("rule_limit")) | (
        direction(F.col("said_sign")) != direction(F.col("rule_sign"))
    )
    return to_notes(
        stated.join(limits, "property").where(conflict),
        kind="guidance_conflict", cluster=F.col("cluster"), property=F.col("property"),
        text=F.concat(F.col("rule_id"), F.lit(": "), F.col("check"), F.lit(" | "), F.col("text")),
        severity="low",
    )
