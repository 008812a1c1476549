"""Exact median per group when a single group may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleet_audit.functions.bounds import MAX_BROADCAST_ROWS, in_large_slots

#: Rows of one group that a single task may hold.
ROWS_PER_TASK = 100_000

_BUCKETS_PER_DOUBLING = 256


def _bucket(value: Column) -> Column:
    """A coarse number that never falls as ``value`` rises; about 13,000 at most in use."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * _BUCKETS_PER_DOUBLING)).cast("int")


def _same(a: DataFrame, b: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{prefix}{k}"]) for k in keys])


def _finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value has a place in an order: not NULL, NaN or infinite. Done once, before any choice of way."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _direct(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median from the order of each group's rows, in one exchange. A hash leads the sort, since it tells most groups apart at once."""
    group = Window.partitionBy("_slot", *keys)
    placed = df.select(*keys, F.xxhash64(*keys).alias("_slot"), F.col(value).alias("_value")).withColumns({
        "_place": F.row_number().over(group.orderBy("_value")), "rows": F.count(F.lit(1)).over(group)})
    middle = (F.col("_place") * 2 >= F.col("rows")) & (F.col("_place") * 2 <= F.col("rows") + 2)
    seen = F.when(middle, F.col("_value").cast("double"))
    return placed.groupBy("_slot", *keys).agg(
        F.max("rows").alias("rows"), F.max("_value").alias("max_value"), ((F.min(seen) + F.max(seen)) / 2).alias("median")).drop("_slot")


def _by_histogram(df: DataFrame, keys: list[str], value: str, few_groups: bool) -> DataFrame:
    """The median from a histogram, bounded in size per group and combined on the map side.

    The histogram tells which one or two buckets hold the middle. Only their values are
    counted and ordered. ``few_groups`` says that the groups were counted and found few;
    then the middle, two rows per group at most, is broadcast.
    """
    bucketed = df.select(*keys, F.col(value).alias("_value"), _bucket(F.col(value)).alias("_bucket"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = ["_before", "rows", "max_value", "_low", "_high"]
    middle = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_value").alias("_max"))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .withColumn("rows", F.sum("_n").over(group))
        .withColumn("max_value", F.max("_max").over(group))
        .withColumn("_low", F.floor((F.col("rows") - 1) / 2))
        .withColumn("_high", F.floor(F.col("rows") / 2))
        .where("_before <= _high and _before + _n > _low")
        .select(*[F.col(k).alias(f"_at_{k}") for k in (*keys, "_bucket")], *place)
    )
    # Counted per value before anything is joined or ordered, so copies of one value cost little.
    counted = bucketed if few_groups else bucketed.groupBy(*keys, "_bucket", "_value").agg(F.count(F.lit(1)).alias("_n"))
    met = counted.join(F.broadcast(middle) if few_groups else middle, _same(counted, middle, [*keys, "_bucket"], "_at_"))
    if few_groups:
        met = met.groupBy(*keys, "_bucket", "_value", *place).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = (
        met.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .where("(_start <= _low and _low < _end) or (_start <= _high and _high < _end)")
    )
    return ranked.groupBy(*keys).agg(
        F.max("rows").alias("rows"),
        F.max("max_value").alias("max_value"),
        ((F.min("_value") + F.max("_value")) / 2).alias("median"),
    )


def grouped_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_limit: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``keys, rows, max_value, median``: the interpolated median and largest value.

    The values of a group are ordered in one task. Groups are counted first, in slots of their hashes; those with more than ``rows_per_task`` rows, usually none,
    go through a histogram instead, and so do all groups when too many are that large.
    Every way is exact.
    """
    known = _finite(df, value)
    suspects = in_large_slots(known, keys, rows_per_task)
    if suspects is None:
        return _direct(known, keys, value)
    large = (
        suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
        .select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    )
    rows = large.limit(broadcast_limit + 1).collect()
    if not rows:
        return _direct(known, keys, value)
    if len(rows) > broadcast_limit:
        return _by_histogram(known, keys, value, few_groups=False)
    marked = F.broadcast(df.sparkSession.createDataFrame(rows, large.schema))
    same = _same(known, marked, keys, "_large_")
    return _direct(known.join(marked, same, "left_anti"), keys, value).unionByName(
        _by_histogram(known.join(marked, same, "left_semi"), keys, value, few_groups=True)
    )
