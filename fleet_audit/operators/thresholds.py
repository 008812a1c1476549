"""Tunable limits, kept as rows: one default per detector, overrides per fleet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit import fixed_values, schemas
from fleet_audit.functions.bounds import MAX_CATALOGUE_ROWS, TooLargeError, bounded_rows


def default_thresholds(spark: SparkSession) -> DataFrame:
    rows = [(d, None, n, float(v)) for d, n, v in fixed_values.DEFAULT_THRESHOLDS]
    return spark.createDataFrame(rows, schemas.THRESHOLDS)


def with_overrides(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Thresholds in which a row of ``own`` replaces the default of the same key."""
    same = [defaults[c].eqNullSafe(own[c]) for c in ("detector", "fleet", "name")]
    return defaults.join(own, same, "left_anti").unionByName(own)


@dataclass(frozen=True)
class Thresholds:
    """A threshold table read once, when it is small enough to be part of the plan."""

    table: DataFrame
    values: dict[tuple[str, str], dict[str | None, float]] | None

    @classmethod
    def of(cls, table: DataFrame | Thresholds, limit: int = MAX_CATALOGUE_ROWS) -> Thresholds:
        """Count the rows and keep them, or keep only the table when there are more than ``limit``."""
        if isinstance(table, Thresholds):
            return table
        try:
            rows = bounded_rows(table, "the threshold table", limit)
        except TooLargeError:
            return cls(table, None)
        values: dict[tuple[str, str], dict[str | None, float]] = {}
        for row in rows:
            if row.value is None:
                continue  # no limit given: as if the row were absent, like max() in the join below
            known = values.setdefault((row.detector, row.name), {})
            known[row.fleet] = max(row.value, known.get(row.fleet, row.value))
        return cls(table, values)


def with_thresholds(
    df: DataFrame, thresholds: DataFrame | Thresholds, detector: str, name: str, column: str = "threshold"
) -> DataFrame:
    """Attach the limit that holds for each row: its fleet's, or else the default.

    A small threshold table becomes a constant lookup in the plan. A large one is
    joined: one row per fleet, so no row is added, and the default is a scalar
    subquery. Rows without a ``fleet`` column get the default.
    """
    limits = Thresholds.of(thresholds)
    has_fleet = "fleet" in df.columns
    if limits.values is not None:
        known = limits.values.get((detector, name), {})
        default = F.lit(known.get(None)).cast("double")
        own = {fleet: value for fleet, value in known.items() if fleet is not None}
        if not own or not has_fleet:
            return df.withColumn(column, default)
        lookup = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])
        return df.withColumn(column, F.coalesce(F.try_element_at(lookup, F.col("fleet")), default))
    mine = limits.table.where((F.col("detector") == detector) & (F.col("name") == name))
    default = mine.where("fleet is null").agg(F.max("value")).scalar()
    if not has_fleet:
        return df.withColumn(column, default)
    own = mine.where("fleet is not null").groupBy("fleet").agg(F.max("value").alias("_own"))
    return (
        df.join(own, "fleet", "left")
        .withColumn(column, F.coalesce(F.col("_own"), default))
        .drop("_own")
    )
