"""Nest rows under a key without putting an unbounded group into one task."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleet_audit.functions.bounds import MAX_CATALOGUE_ROWS, in_large_slots
from fleet_audit.sources.stores import materialize

#: Most rows nested into one array by default.
ROWS_PER_PART = 10_000


def _with_part(items: DataFrame, keys: list[str], names: list[str], rows_per_part: int, limit: int) -> DataFrame | None:
    """``items`` with ``part`` and ``parts``: the rows the items of their key are spread over; None when no key has more than one.

    Keys are counted first, in slots of their hashes. Mostly none is too large, and then nothing is joined. A few
    large ones are broadcast after that count; more of them are joined by key.
    """
    suspects = in_large_slots(items, keys, rows_per_part)
    if suspects is None:
        return None
    large = (
        suspects.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("parts"))
        .where("parts > 1")
    )
    rows = large.limit(limit + 1).collect()
    if not rows:
        return None
    known = large if len(rows) > limit else F.broadcast(items.sparkSession.createDataFrame(rows, large.schema))
    small = items.join(known, keys, "left_anti").withColumns({"parts": F.lit(1), "part": F.lit(0)})
    numbered = _numbered(items.join(known, keys), keys, [F.col(n).asc_nulls_last() for n in names])
    part = F.floor((F.col("_number") - 1) / rows_per_part).cast("int")
    return small.unionByName(numbered.withColumn("part", part).drop("_number"))


def _numbered(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``items`` with ``_number``, their place from 1 in the order of their key.

    Items are dealt out by ranges of that order, each with a number of its own behind it so that copies of one
    item can be split; a range is numbered by itself and moved by the counts of the ranges before.
    """
    stored = materialize(items.withColumn("_tie", F.monotonically_increasing_id()))
    ranges = materialize(stored.repartitionByRange(*keys, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order, "_tie"))
    placed = ranges.withColumn("_place", place).join(offsets, [*keys, "_range"])
    return placed.withColumn("_number", F.col("_place") + F.col("_before")).drop("_place", "_before", "_range", "_tie")


def nest_all(
    kinds: Mapping[str, tuple[DataFrame, Column]],
    keys: list[str],
    rows_per_part: int = ROWS_PER_PART,
    broadcast_limit: int = MAX_CATALOGUE_ROWS,
) -> DataFrame:
    """``keys, part, parts`` and one sorted array per kind; a kind without items is NULL.

    ``kinds`` maps the name of an array to a table and the expression of its items. All
    kinds meet in one aggregation. A key with up to ``rows_per_part`` items gives one row
    (part 0 of 1). A larger one continues in order over as many rows as needed: part n
    holds the items that follow those of part n - 1, kind by kind. No task holds more than a
    range of a key, copies of one item may be split, and nothing is dropped. The tables are
    read twice, once for the keys alone.
    """
    names = list(kinds)
    items = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.select(*keys, item.alias(name)) for name, (df, item) in kinds.items()],
    )
    arrays = [F.sort_array(F.collect_list(name)).alias(name) for name in names]
    parted = _with_part(items, keys, names, rows_per_part, broadcast_limit)
    if parted is None:
        # Grouped by nothing but the keys, what is nested lies right for a join by them and is not exchanged again.
        nested = items.groupBy(*keys).agg(*arrays).select(*keys, F.lit(0).alias("part"), F.lit(1).alias("parts"), *names)
    else:
        nested = parted.groupBy(*keys, "part").agg(F.max("parts").alias("parts"), *arrays)
    return nested.withColumns({n: F.when(F.size(n) > 0, F.col(n)) for n in names})


def nest_rows(df: DataFrame, keys: list[str], item: Column, name: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """:func:`nest_all` for one kind of item."""
    return nest_all({name: (df, item)}, keys, rows_per_part)
