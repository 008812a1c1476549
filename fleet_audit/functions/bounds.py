"""Size checks that stand in front of anything the driver or every executor must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Largest catalogue-like table (rules, signals, patterns) read into the plan itself.
MAX_CATALOGUE_ROWS = 5_000

#: Most rows of narrow keys sent to every executor.
MAX_BROADCAST_ROWS = 100_000

#: Slots of hashes in which keys are counted together.
SLOTS = 65_536


class TooLargeError(ValueError):
    """A table that must be small is not."""


def bounded_rows(df: DataFrame, what: str, limit: int = MAX_CATALOGUE_ROWS) -> list[Row]:
    """Rows of a catalogue-like table; raises instead of cutting when there are more.

    At most ``limit + 1`` rows ever reach the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLargeError(f"{what} has more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Narrow keys marked for broadcast once they are counted; unchanged when there are more.

    For the small side of a join whose other side is too wide to shuffle. A side beyond
    the limit joins by key like any other. ``df`` is computed once when it is small and
    twice when it is not, so it should come from a written table.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def in_large_slots(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Rows whose key may have more than ``limit`` rows; None when no key has.

    Keys are counted together in slots of their hashes, so counting exchanges a few slots of each task and not the keys. A key
    beyond the limit lies in a slot beyond it.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    large = [r["_slot"] for r in df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).collect()]
    if not large:
        return None
    return df if len(large) == SLOTS else df.where(slot.isin(large))
