"""Ranks of rows by a distributed radix sort, least significant digit first.

The keys are cut into digits. Each pass is a stable counting sort by one digit: rows lie in blocks of successive positions;
a block counts its rows per digit, running sums over digits and blocks give every (digit, block) its first place, and a row goes to
that place plus its number among the rows of its block and digit. After the pass for the highest digit the positions are the ranks.

No task holds more than a block, whatever the keys are, and no pass compares keys. The result of each
pass is written, so that a lost executor repeats one pass at most. Rows equal in all keys keep the order in which they
were stored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleet_audit.llm.shared import dropped, kept, unused

#: Positions in a block.
BLOCK_ROWS = 1 << 14
#: Widest digit: so many bits, 1,024 values.
DIGIT_BITS = 10
_WHOLE = 1 << 63


def digits_of(rows: DataFrame, keys: list[str]) -> list[tuple[Column, int]]:
    """The digits that tell ``rows`` apart, the least significant first, each with its number of values.

    ``keys`` are long columns without nulls, the most important one first. What all rows share has no digit.
    """
    ends = rows.agg(*(f(k).alias(f"{name}_{i}") for i, k in enumerate(keys) for name, f in (("least", F.min), ("most", F.max)))).first()
    out: list[tuple[Column, int]] = []
    for i, key in reversed(list(enumerate(keys))):
        least, most = ends[f"least_{i}"], ends[f"most_{i}"]
        if least is None:
            continue
        if most - least < _WHOLE:
            parts = [(F.col(key) - F.lit(least), most - least)]
        else:  # the difference of such keys is no long; their halves are keys of their own
            halves = [(F.col(key).bitwiseAND(F.lit(0xFFFFFFFF)), (1 << 32) - 1), (F.shiftright(key, 32) - F.lit(least >> 32), (most >> 32) - (least >> 32))]
            parts = halves
        for value, width in parts:
            bits = width.bit_length()
            count = -(-bits // DIGIT_BITS)
            for n in range(count):
                low, high = bits * n // count, bits * (n + 1) // count
                digit = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
                out.append((digit.cast("int"), 1 << (high - low)))
    return out


def counting_pass(rows: DataFrame, digit: Column, place: str) -> DataFrame:
    """``rows`` in the stable order of ``digit``: their ``place`` is now their position, from 0 without gaps."""
    dealt = rows.select("*", digit.alias("_digit"), F.shiftright(place, BLOCK_ROWS.bit_length() - 1).alias("_block"))
    counts = kept(dealt.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("n")), "counts")
    # As many rows as a digit has values.
    totals = counts.groupBy("_digit").agg(F.sum("n").alias("n"))
    firsts = totals.select("_digit", F.coalesce(F.sum("n").over(W.orderBy("_digit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_digit").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_digit", "_block", before.alias("before")).join(F.broadcast(firsts), "_digit")
    number = F.row_number().over(W.partitionBy("_digit", "_block").orderBy(place)) - 1
    placed = dealt.select("*", number.alias("_number")).join(offsets, ["_digit", "_block"])
    columns = [c for c in rows.columns if c != place]
    return kept(placed.select(*columns, (F.col("first") + F.col("before") + F.col("_number")).cast("long").alias(place)), "sorted")


def radix_ranks(rows: DataFrame, keys: list[str], rank_col: str = "rank") -> DataFrame:
    """``rows`` with ``rank_col``: 1 for the smallest by ``keys``, 2 for the next and so on."""
    place = unused(rows, "place")
    placed = kept(rows.withColumn(place, F.monotonically_increasing_id()), "sorted")
    digits = digits_of(placed, keys) or [(F.lit(0), 1)]
    for digit, _ in digits:
        further = counting_pass(placed, digit, place)
        dropped(placed)
        placed = further
    return placed.select(*rows.columns, (F.col(place) + 1).alias(rank_col))
