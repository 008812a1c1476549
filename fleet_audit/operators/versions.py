"""Which engine version a cluster runs, and which rules apply to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit import fixed_values
from fleet_audit.functions.bounds import bounded_rows
from fleet_audit.functions.versions import version_array, version_in_gate


def detect_versions(entries: DataFrame, keys=fixed_values.VERSION_KEYS) -> DataFrame:
    """``cluster, detected_version`` from entries that state it; coordinators win."""
    known = entries.where(F.col("key").isin(list(keys)) & version_array(F.col("raw")).isNotNull())
    order = F.struct((F.col("role") == "coordinator").cast("int"), version_array(F.col("raw")))
    return known.groupBy("cluster").agg(F.max_by("raw", order).alias("detected_version"))


def version_hints(context: DataFrame) -> DataFrame:
    """``cluster, version_hint`` from context rows; NULL cluster holds for all."""
    hints = context.where("engine_version_hint is not null")
    return hints.groupBy("cluster").agg(
        F.max_by("engine_version_hint", version_array(F.col("engine_version_hint"))).alias("version_hint")
    )


def resolve_version(snapshot: DataFrame) -> DataFrame:
    """From ``detected_version`` and ``version_hint``: a detected version always wins.

    Adds ``engine_version``, ``version`` (comparable) and ``version_source``.
    """
    detected, hint = F.col("detected_version").cast("string"), F.col("version_hint").cast("string")
    chosen = F.coalesce(detected, hint)
    return snapshot.select(
        *[c for c in snapshot.columns if c not in ("detected_version", "version_hint")],
        chosen.alias("engine_version"),
        version_array(chosen).alias("version"),
        F.when(detected.isNotNull(), "detected").when(hint.isNotNull(), "hint").otherwise("unknown")
        .alias("version_source"),
    )


def config_snapshot(files: DataFrame, entries: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One row per backed-up cluster with its version, roles and backup time."""
    clusters = files.groupBy("cluster").agg(
        F.max("modified_at").alias("backed_up_at"), F.array_sort(F.collect_set("role")).alias("roles")
    )
    known = clusters.join(detect_versions(entries), "cluster", "left")
    if context is None:
        return resolve_version(known.withColumn("version_hint", F.lit(None).cast("string")))
    hints = version_hints(context)
    overall = hints.where("cluster is null").agg(F.max("version_hint")).scalar()
    own = hints.where("cluster is not null")
    hinted = known.join(own, "cluster", "left").withColumn(
        "version_hint", F.coalesce(F.col("version_hint"), overall)
    )
    return resolve_version(hinted)


def _gate_literals(rules: DataFrame, *columns: str):
    """Distinct gates of the bounded catalogue as (gate column, row) pairs."""
    rows = bounded_rows(rules.select("gates", *columns), "the rule catalogue")
    for row in rows:
        gates = F.array(*[
            F.struct(F.lit(g.op).alias("op"), F.array(*[F.lit(v) for v in g.version]).alias("version"))
            for g in row.gates
        ]) if row.gates else None
        applies = F.lit(True) if gates is None else version_in_gate(F.col("version"), gates)
        yield applies, row


def version_gate(rules: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``cluster, rule_id, applies``: a rule outside the version is skipped, not failed.

    The catalogue is bounded and compiled into the projection, so a cluster row is
    exploded in place and nothing is joined or shuffled.
    """
    verdicts = [
        F.struct(F.lit(row.rule_id).alias("rule_id"), applies.alias("applies"))
        for applies, row in _gate_literals(rules, "rule_id")
    ]
    return snapshot.select("cluster", F.explode(F.array(*verdicts)).alias("_v")).select("cluster", "_v.*")


def rule_run_counts(rules: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``cluster, rules_evaluated, rules_skipped_version``; both add up to the catalogue."""
    by_gate = rules.groupBy("gates").agg(F.count(F.lit(1)).cast("long").alias("n"))
    evaluated, total = F.lit(0).cast("long"), 0
    for applies, row in _gate_literals(by_gate, "n"):
        evaluated = evaluated + F.when(applies, F.lit(row.n)).otherwise(F.lit(0)).cast("long")
        total += row.n
    return snapshot.select(
        "cluster", evaluated.alias("rules_evaluated"),
        (F.lit(total).cast("long") - evaluated).alias("rules_skipped_version"),
    )
