"""Shards of equal counts that keep linked documents together, by balanced label propagation.

Documents of equal text are linked. Each starts in a shard drawn by its id; in every round a group
counts its members per shard, and members outside the shards where the group is strongest move
there. A move needs room: a shard takes in only as many as its quota still allows, strongest pull
first. Documents without links feel no pull and fill the shards up at the end, so that counts
differ by one at most. A group larger than a shard gathers in as few shards as it needs.

All steps work on rows of group and shard, not on pairs of documents. A null text has no bytes and is linked
to other null texts, an empty one to other empty ones; null ids are placed like any other. Rows
are told apart by a number of their own, so repeated rows are each placed. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleet_audit.llm.shared import dropped, kept

#: Rounds at most; propagation ends earlier when no document moves.
ROUNDS = 12
#: Rows numbered together in one task, and the buckets in which moves of one pull are admitted.
NUMBERED_TOGETHER = 10_000
MOVE_BUCKETS = 256


def linked_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, <id>, size, crc, grp`` per document: bytes of the text plus 16, its CRC-32 and what stands for its text."""
    text = F.col(text_col)
    return kept(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("grp")), "rows")


def propagate(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``row, grp, shard`` for rows of linked documents, given ``row, grp, shard``; no shard gets more than its quota."""
    shards = len(quotas)
    quota = F.array(*map(F.lit, quotas))
    mean = max(1, sum(quotas) // shards)
    for turn in range(rounds):
        counts = kept(linked.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "pulls")
        held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, quotas[s] - held.get(s, 0)) for s in range(shards)]
        rooms = F.array(*map(F.lit, room))
        own = F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")
        of_group = counts.groupBy("grp").agg(F.sum("n").alias("members"), F.array_sort(F.collect_list(own)).alias("pulls")).filter(F.size("pulls") > 1)
        # A group needs so many shards; the strongest pulls that have room are its targets.
        wanted = F.greatest(F.lit(1), F.ceil(F.col("members") / mean)).cast("int")
        pulls = F.reverse("pulls")
        open_ones = F.filter(pulls, lambda p: F.get(rooms, p["shard"]) > 0)
        ranked = of_group.select("grp", wanted.alias("wanted"), pulls.alias("pulls"), open_ones.alias("open")).select(
            "grp", "wanted", "open", F.posexplode("pulls").alias("rank", "p")).filter("rank >= 1")
        better = F.filter("open", lambda q: q > F.col("p"))
        aims = ranked.withColumn("better", F.slice(better, 1, F.col("wanted"))).filter("size(better) > 0")
        # Members beyond the first ``wanted`` shards move; those within may only give up a shard for a fuller one when the group fits in one.
        aims = aims.filter((F.col("rank") >= F.col("wanted")) | (F.col("wanted") == 1))
        target = F.get("better", F.pmod(F.col("rank") + turn, F.size("better")))
        aims = aims.select("grp", F.col("p.shard").alias("shard"), target["shard"].alias("to"), (target["n"] - F.col("p.n")).alias("gain"), F.col("p.n").alias("moving"))
        if aims.isEmpty():
            dropped(counts)
            break
        spread = F.when(F.col("moving") * 16 > F.get(rooms, F.col("to")), F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(MOVE_BUCKETS))).otherwise(0)
        bucket = F.pmod(F.xxhash64("grp", F.lit(turn)) + spread, F.lit(MOVE_BUCKETS)).cast("int")
        level = F.floor(F.log2(F.col("gain") + 1)).cast("int")
        moves = kept(linked.join(aims, ["grp", "shard"], "left").select("row", "grp", "shard", "to", level.alias("level"), bucket.alias("bucket")), "moves")
        dropped(counts)
        asked = moves.filter("to is not null").groupBy("to", "level", "bucket").agg(F.count(F.lit(1)).alias("n"))
        running = F.sum("n").over(W.partitionBy("to").orderBy(F.desc("level"), "bucket"))
        # At most shards * levels * buckets rows, whatever the size of the corpus.
        admitted = asked.withColumn("running", running).filter(F.col("running") <= F.get(rooms, F.col("to"))).select("to", "level", "bucket", F.lit(True).alias("admitted"))
        placed = moves.join(F.broadcast(admitted), ["to", "level", "bucket"], "left")
        linked = kept(placed.select("row", "grp", F.when(F.col("admitted"), F.col("to")).otherwise(F.col("shard")).alias("shard")), "shards")
        dropped(moves)
    return linked


def _within_quota(linked: DataFrame, quotas: list[int]) -> DataFrame:
    """Start shards of linked rows, by a hash of the row; what exceeds a quota is dealt over the shards with room."""
    shards = len(quotas)
    drawn = linked.withColumn("shard", F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).cast("int"))
    numbered, counts = _numbered(drawn, ["shard"], sum(quotas))
    room = [q - counts.get((s,), 0) for s, q in enumerate(quotas)]
    over = F.col("number") >= F.get(F.array(*map(F.lit, quotas)), F.col("shard"))
    spare, _ = _numbered(numbered.filter(over).drop("number"), [], sum(quotas))
    ends, total = [], 0
    for r in room:
        total += max(0, r)
        ends.append(total)
    moved = spare.withColumn("shard", _slot_shard(F.col("number"), ends))
    return kept(numbered.filter(~over).drop("number").unionByName(moved.drop("number")), "shards")


def _slot_shard(number: Column, ends: list[int]) -> Column:
    """The shard whose range of numbers, ending before ``ends``, holds ``number``."""
    return F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= number))


def _numbered(rows: DataFrame, keys: list[str], total: int) -> tuple[DataFrame, dict[tuple, int]]:
    """``rows`` with a gapless ``number`` from 0 within ``keys``, and the rows per key.

    Rows are numbered within blocks, each offset by the blocks before it, so that no task holds a whole shard.
    """
    blocks = max(1, total // NUMBERED_TOGETHER)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int"))
    sizes = blocked.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = kept(sizes.select(*keys, "block", "n", F.coalesce(before, F.lit(0)).alias("offset")), "offsets")
    counts = {tuple(r[k] for k in keys): r["n"] for r in offsets.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}
    in_block = F.row_number().over(W.partitionBy(*keys, "block").orderBy("row")) - 1
    numbered = blocked.withColumn("in_block", in_block).join(offsets.drop("n"), [*keys, "block"])
    return numbered.select(*rows.columns, (F.col("in_block") + F.col("offset")).cast("long").alias("number")), counts


def balanced_shards(docs: DataFrame, shards: int, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, <id>, size, crc, grp, shard, slot`` per document."""
    rows = linked_rows(docs, id_col, text_col)
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    several = kept(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp"), "groups")
    linked = kept(rows.join(several, "grp", "left_semi").select("row", "grp"), "linked")
    linked = propagate(_within_quota(linked, quotas), quotas, rounds)
    placed, held = _numbered(linked.select("row", "shard"), ["shard"], total)
    alone, _ = _numbered(rows.join(linked.select("row"), "row", "left_anti").select("row"), [], total)
    ends, starts, filled = [], [], 0
    for s in range(shards):
        starts.append(filled - held.get((s,), 0))
        filled += quotas[s] - held.get((s,), 0)
        ends.append(filled)
    shard = _slot_shard(F.col("number"), ends)
    alone = alone.select("row", shard.alias("shard"), "number").withColumn("slot", F.col("number") - F.get(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("shard")))
    every = placed.select("row", "shard", F.col("number").alias("slot")).unionByName(alone.select("row", "shard", "slot"))
    return rows.join(every, "row")


def cut_links(sharded: DataFrame) -> DataFrame:
    """``links, cut``: pairs of documents of equal text, and those of them in different shards."""
    parts = sharded.groupBy("grp", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = parts.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    links = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    return whole.agg(links.alias("links"), (links - F.coalesce(F.sum("kept"), F.lit(0.0))).alias("cut"))
