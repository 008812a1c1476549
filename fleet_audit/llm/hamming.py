"""Links between 64-bit fingerprints within a Hamming radius, by multi-index hashing.

The bits are cut into segments. Two fingerprints within the radius differ so little in at least
one segment that a small Hamming ball around the one's segment value holds the other's. Each
fingerprint is filed under its segment values, looks up the balls around them, and the complete
distance decides. Nothing is lost: the ball sizes come from the pigeonhole rule.

A large group of fingerprints close to each other is not expanded into its pairs. Each bucket
names the fingerprint with the most rows as its centre; members link to the centre, and pairs
whose ends both link to it are left out, since they are connected already.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Up to so many distinct fingerprints three segments (45 lookups each at radius 4) find few
#: strangers in a bucket; beyond it two wider segments (562 lookups) do. The links are the same.
WIDE_FROM = 1 << 25
#: Most fingerprints that are sent to every executor under their two or three keys. Beyond it both sides are joined by key, as the hint must
#: say: Spark takes the look-ups, some 45 or 560 a fingerprint, to be no larger than the fingerprints and would broadcast them.
BROADCAST_PRINTS = 50_000


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """``(shift, width, ball radius)`` of each segment that must be looked up.

    With ``radius = segments * q + r``, two fingerprints within ``radius`` differ in at most ``q`` bits in
    one of the first ``r + 1`` segments or in at most ``q - 1`` bits in one of the others.
    """
    q, r = divmod(radius, segments)
    out, shift = [], 0
    for k in range(segments):
        width = (BITS - shift) // (segments - k)
        ball = q if k <= r else q - 1
        if ball >= 0:
            out.append((shift, width, ball))
        shift += width
    return out


def ball_masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _key(segment: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(segment << 40).cast("long"))


def _segment(print_: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(print_, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _ball(key: Column, width: int, radius: int) -> Column:
    masks = F.array(*(F.lit(m).cast("long") for m in ball_masks(width, radius)))
    return F.transform(masks, lambda mask: key.bitwiseXOR(mask))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _own_keys(plan: list[tuple[int, int, int]]) -> Column:
    return F.array(*(_key(k, _segment(F.col("print"), s, w)) for k, (s, w, _) in enumerate(plan)))


def _ball_keys(plan: list[tuple[int, int, int]]) -> Column:
    return F.flatten(F.array(*(_ball(_key(k, _segment(F.col("print"), s, w)), w, ball) for k, (s, w, ball) in enumerate(plan))))


def hamming_links(prints: DataFrame, radius: int, segments: int | None = None, table: str | None = None) -> DataFrame:
    """``a, b`` (and ``table``): links that connect what lies within ``radius``.

    ``prints`` has distinct rows of ``print`` (long) and ``n``, its number of rows; with ``table``, a column of
    that name keeps several sets of fingerprints apart. The result may hold a link twice.
    """
    count = prints.count()
    plan = segment_plan(radius, segments or (3 if count <= WIDE_FROM else 2))
    joined = "broadcast" if count <= BROADCAST_PRINTS else "merge"
    names = [table] if table else []
    filed = prints.select(*names, "print", "n", F.explode(_own_keys(plan)).alias("key"))
    centres = filed.groupBy(*names, "key").agg(F.max_by("print", F.struct("n", "print")).alias("centre"))
    filed = filed.join(centres.hint(joined), [*names, "key"]).select(
        *names, "key", F.col("print").alias("b"), "centre", (distance(F.col("print"), F.col("centre")) <= radius).alias("b_near"))
    looked_up = prints.select(*names, F.col("print").alias("a"), F.explode(_ball_keys(plan)).alias("key"))
    a_near = distance(F.col("a"), F.col("centre")) <= radius
    wanted = (F.col("b") == F.col("centre")) | ((F.col("a") < F.col("b")) & ~(F.col("b_near") & a_near))
    on = F.expr(" and ".join(f"l.{c} = f.{c}" for c in [*names, "key"]))
    close = (F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= radius)
    return looked_up.alias("l").join(filed.alias("f").hint(joined), on & close & wanted).select(*(F.col(f"l.{c}") for c in names), "a", "b")
