"""A prefix trie of conversations, by digests of fixed-length blocks of turns.

The turns of a conversation are cut into blocks of ``BLOCK_TURNS``. A block has one digest, and the digests of the first j blocks
add up to a path; conversations of equal paths share all nodes of these blocks, so a whole group of them is one row from there
on. Paths of one parent path that differ are siblings: only where there are several are their turns compared one by one, by digests of
the turns from the start of the block, to find how far they agree. A path without siblings has its turns as nodes as they are.

A node is named by the smallest conversation below it and its depth, which is unique. A conversation's *own* nodes, those it names, are the last ones of
its path, from depth ``first_own`` on. Every node of a subtree is owned by one conversation below the top. So the sums over a
subtree need no walk over it: per conversation they are differences of running sums, added up by path and then by node.

Every step is a join or an aggregation on keys; running sums of a very long conversation are taken in pieces, and the ids that end at one
node are hashed as a stream of pieces, so no group is held whole. The input to ``prefix_trie`` has one row per turn
and ``numbered_turns`` makes it of any table: it orders turns by ``turn``, null first, then by their digest. A null role or text is empty.
Rows without a conversation id belong to no conversation and take no part. Repeated rows are turns of their own. Empty tables
give no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleet_audit.llm.shared import kept

BLOCK_TURNS = 8
#: Rows of a running sum taken together.
PIECE_ROWS = 1 << 12
#: Ids put together at a time, as bits of an id.
_ID_BITS = 12
_LANES = [f"lane{k}" for k in range(4)]


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``conv, place, digest, chars`` of every turn, ``place`` from 1 without gaps, and ``conv, turns`` of every conversation.

    All turns are sorted as one table and numbered through; a place is the distance to the conversation's first one.
    """
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"))
    order = ["conv", F.col("turn").asc_nulls_first(), "digest"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = kept(ordered.select("conv", F.unhex("digest").alias("digest"), "chars", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "turns")
    parts = ordered.groupBy("part").agg((F.max("at") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row per partition of the sort.
    numbered = ordered.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("conv", "digest", "chars", (F.col("at") + F.col("before")).alias("number"))
    convs = kept(numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("turns")), "convs")
    placed = numbered.join(convs.select("conv", "first"), "conv").select("conv", (F.col("number") - F.col("first") + 1).alias("place"), "digest", "chars")
    return placed, convs.select("conv", "turns")


def running_sums(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with each of ``columns`` replaced by its sum over the rows of ``key`` up to this one; ``order`` counts them from 0.

    Sums run within pieces of ``PIECE_ROWS`` rows, and then over the pieces.
    """
    pieces = rows.withColumn("_piece", F.floor(F.col(order) / PIECE_ROWS).cast("long"))
    totals = pieces.groupBy(key, "_piece").agg(*(F.sum(c).alias(c) for c in columns))
    over = W.partitionBy(key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(key, "_piece", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_before_{c}") for c in columns))
    inside = W.partitionBy(key, "_piece").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = pieces.select(*(c for c in pieces.columns if c not in columns), *(F.sum(c).over(inside).alias(c) for c in columns)).join(before, [key, "_piece"])
    return summed.select(*(c for c in rows.columns if c not in columns), *((F.col(c) + F.col(f"_before_{c}")).alias(c) for c in columns))


def _path(block: Column, lanes: list[Column]) -> Column:
    """A short name of the first blocks of a conversation; empty in front of the first one."""
    return F.when(block < 0, F.lit("")).otherwise(F.substring(F.sha2(F.concat_ws(",", block.cast("string"), *(x.cast("string") for x in lanes)), 256), 1, 32))


def blocks_of(turns: DataFrame) -> DataFrame:
    """``conv, block, path, above, digests, chars, through``: each block, its path and that above it, its turns, and the characters up to its end."""
    block = F.floor((F.col("depth") - 1) / BLOCK_TURNS).cast("long")
    rows = turns.groupBy("conv", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "chars"))).alias("t"))
    rows = rows.select("conv", "block", F.col("t.digest").alias("digests"), F.col("t.chars").alias("chars"))
    name = F.sha2(F.concat(F.col("block").cast("string"), F.lit(":"), F.concat_ws("", F.transform("digests", F.hex))), 256)
    rows = rows.withColumn("name", name).select("*", *(F.conv(F.substring("name", 1 + 8 * k, 8), 16, 10).cast("long").alias(lane) for k, lane in enumerate(_LANES)))
    rows = kept(rows.drop("name").withColumn("through", F.aggregate("chars", F.lit(0).cast("long"), lambda a, n: a + n)), "blocks")
    narrow = rows.select("conv", "block", *_LANES, "through")
    ends = running_sums(narrow, "conv", "block", [*_LANES, "through"]).withColumnsRenamed({c: f"to_{c}" for c in [*_LANES, "through"]})
    both = rows.join(ends, ["conv", "block"])
    upto = [F.col(f"to_{lane}") for lane in _LANES]
    above = [F.col(f"to_{lane}") - F.col(lane) for lane in _LANES]
    return kept(both.select(
        "conv", "block", _path(F.col("block"), upto).alias("path"), _path(F.col("block") - 1, above).alias("above"), "digests", "chars", F.col("to_through").alias("through")), "paths")


def _spots(groups: DataFrame) -> DataFrame:
    """``path, conv, n, depth, at, chars, node, parent``: each turn of each path, with the smallest conversations of its node and of the node above."""
    siblings = groups.groupBy("above").agg(F.count(F.lit(1)).alias("siblings"))
    over = groups.select(F.col("path").alias("above"), F.col("conv").alias("conv_above"))
    found = groups.join(siblings.join(over, "above", "left"), "above")
    chain = F.aggregate(
        "digests", F.array().cast("array<string>"),
        lambda seen, d: F.concat(seen, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("")), F.hex(d)), 256))))
    several = F.col("siblings") > 1
    found = found.withColumn("chain", F.when(several, chain).otherwise(F.transform("digests", lambda d: F.lit("").cast("string"))))
    each = found.select("path", "above", "conv", "conv_above", "n", "block", several.alias("several"), F.posexplode(F.arrays_zip("chain", "chars")).alias("at", "turn"))
    each = kept(each.select("path", "above", "conv", "conv_above", "n", (F.col("block") * BLOCK_TURNS + F.col("at") + 1).alias("depth"), "several", "at", F.col("turn.chain").alias("chain"), F.col("turn.chars").alias("chars")), "spots")
    refined = each.filter("several").groupBy("above", "at", "chain").agg(F.min("conv").alias("node"))
    columns = ["path", "conv", "conv_above", "n", "depth", "at", "chars"]
    named = each.filter("several").join(refined, ["above", "at", "chain"]).select(*columns, "node").unionByName(each.filter("not several").select(*columns, F.col("conv").alias("node")))
    parent = F.when(F.col("at") == 0, F.col("conv_above")).otherwise(F.lag("node").over(W.partitionBy("path").orderBy("at")))
    return kept(named.select("path", "conv", "n", "depth", "at", "chars", "node", parent.alias("parent")), "nodes")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` (``conv, depth, digest, chars``) has depths from 1 without gaps; ``convs`` (``conv``) has every conversation, also those without turns.
    """
    blocks = blocks_of(turns)
    counted = blocks.groupBy("path").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"))
    groups = kept(blocks.join(counted, ["path", "conv"]).select("path", "above", "conv", "n", "block", "digests", "chars"), "groups")
    spots = _spots(groups)
    nodes = spots.filter("conv = node")
    children = nodes.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    own = spots.filter("conv = node").groupBy(F.col("node").alias("conv")).agg(F.min("depth").alias("first_own"))
    # The node above the first turns has no name yet: it is the root, and its children have no parent.
    leaves = kept(nodes.join(children, ["node", "depth"], "left_anti").select(F.col("node").alias("conv"), F.lit(1).cast("long").alias("leaf")), "leaves")

    # Per conversation and block: characters behind the block that other conversations own, and whether it owns a leaf.
    at_depth = F.transform("chars", lambda c, i: F.when(F.col("first_own").isNull() | (F.col("block") * BLOCK_TURNS + i + 1 < F.col("first_own")), c).otherwise(F.lit(0)))
    marked = blocks.select("conv", "block", "path", "chars", "through").join(own, "conv", "left")
    marked = kept(marked.select("conv", "block", "path", "through", F.aggregate(at_depth, F.lit(0).cast("long"), lambda a, c: a + c).alias("shared")), "shared")
    whole = marked.groupBy("conv").agg(F.sum("shared").alias("all_shared"), F.max("block").alias("last"))
    whole = whole.join(leaves, "conv", "left")
    placed = kept(marked.join(whole, "conv").select(
        "conv", "path", F.greatest(F.lit(0), F.col("all_shared") - F.col("through")).alias("behind"), F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("block") == F.col("last")).alias("ends")), "placed")
    by_path = placed.groupBy("path").agg(F.sum("behind").alias("behind"), F.sum("leaf").alias("leaf"))

    # Per path and turn: what its block holds from this turn on.
    rest = F.sum("chars").over(W.partitionBy("path").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, W.currentRow))
    not_own = F.sum(F.when(F.col("conv") != F.col("node"), F.col("chars")).otherwise(0)).over(W.partitionBy("path").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = spots.select("path", "node", "depth", "n", rest.alias("rest"), not_own.alias("not_own")).join(by_path, "path")
    sums = parts.groupBy("node", "depth").agg(
        F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("behind") + (F.col("n") - 1) * F.col("rest") + F.col("not_own")).alias("saved_tokens"))
    inner = nodes.select("node", "depth", "parent", "chars").join(sums, ["node", "depth"]).join(children, ["node", "depth"], "left")
    inner = kept(inner.select("node", "depth", "parent", "chars", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens"), "trie")

    # The root is one row, made of the sums of two tables.
    zero = F.lit(0).cast("long")
    every = convs.agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs")).first()
    below = inner.agg(
        F.coalesce(F.sum(F.when(F.col("depth") == 1, 1)), zero).alias("n_children"), F.coalesce(F.sum(F.when(F.col("n_children") == 0, 1)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), zero).alias("saved_tokens")).first()
    root = [(every["node"], 0, None, every["n_convs"], *below)] if every["n_convs"] else []
    top = convs.sparkSession.createDataFrame(root, "node long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    inner = inner.drop("chars").withColumn("parent", F.coalesce("parent", F.lit(every["node"]).cast("long")))

    last = spots.groupBy("path").agg(F.max(F.struct("depth", "node")).alias("last")).select("path", "last.node", "last.depth")
    ended = placed.filter("ends").select("conv", "path").join(last, "path").select("node", "depth", "conv")
    turnless = convs.select("conv").join(blocks.select("conv").distinct(), "conv", "left_anti").select(F.lit(every["node"]).cast("long").alias("node"), zero.alias("depth"), "conv")
    hashes = ends_digests(ended.unionByName(turnless.select("node", "depth", "conv")))
    out = inner.unionByName(top).join(hashes, ["node", "depth"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def ends_digests(ended: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256``: the SHA-256 of the ids of ``ended`` (``node, depth, conv``), ascending, comma-joined.

    Ids are joined in pieces of at most 4,096; the pieces of a node then stream through its hash in order.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ended.groupBy("node", "depth", F.shiftright("conv", _ID_BITS).alias("piece")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], ["node", "depth", "ends_sha256"])

        for batch in batches:
            out: list[pa.RecordBatch] = []
            for node, depth, text in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if (node, depth) == key:
                    digest.update(b"," + text.encode())
                else:
                    if key is not None:
                        out.append(row())
                    key, digest = (node, depth), hashlib.sha256(text.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key is not None:
            yield row()

    ordered = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece")
    return ordered.select("node", "depth", "ids").mapInArrow(run, "node long, depth long, ends_sha256 string")
