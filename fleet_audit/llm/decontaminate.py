"""Benchmark passages in a corpus, found by the SimHash of windows as long as the benchmark items.

Texts and items are cut into words (runs of letters and digits, in lower case). Windows of an item's
length are placed wherever one of its word shingles lines up with the same shingle in a text: a
window without any common shingle has similarity zero, so nothing is lost by not looking at it.
Equal windows are looked at once. Each has a SimHash over its shingles, weighted by how often they
occur in it; items of the same length are filed under the Hamming balls around the blocks of
their own SimHash, so that a look-up by block finds every item within ``RADIUS`` bits. The weighted
Jaccard similarity of the shingles themselves, not of hashes, then decides.

Null and empty texts or items, and those without words, take no part. Items shorter than a shingle
are one shingle. Repeated rows are each reported; equal items are told apart by their id. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit.llm.hamming import ball_masks, distance
from fleet_audit.llm.shared import kept

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in about ten bits of 64; sixteen leaves out one in a hundred of the borderline.
RADIUS = 16
BLOCKS = 8
#: Most places of shingles in all items that are sent to every executor; beyond it they are joined by hash.
BROADCAST_SHINGLES = 200_000
#: Most items that are sent to every executor under all keys of their balls (some 300 each); Spark takes these for one row each.
BROADCAST_ITEMS = 1_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Shingles as text; fewer words than a shingle are one shingle."""
    starts = F.when(F.size(words) >= WORDS, F.sequence(F.lit(1), F.size(words) - (WORDS - 1))).when(F.size(words) > 0, F.array(F.lit(1)))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k, WORDS), " "))


def shingle_hashes(words: Column) -> Column:
    """Hashes of the same shingles, made without building their text."""
    starts = F.when(F.size(words) >= WORDS, F.sequence(F.lit(0), F.size(words) - WORDS)).when(F.size(words) > 0, F.array(F.lit(0)))
    return F.transform(starts, lambda k: F.xxhash64(*(F.coalesce(F.get(words, k + i), F.lit("")) for i in range(WORDS))))


def simhash_of(shingles: DataFrame, *keys: str) -> DataFrame:
    """``<keys>, print`` from rows of ``<keys>, h``, one row per occurrence of a shingle.

    The 64 counters lie in 32 sums of two lanes of 32 bits.
    """
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit((1 << 32) + 1).cast("long"))).alias(f"c{k}") for k in range(32)]
    counted = shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lanes)
    print_ = F.lit(0).cast("long")
    for bit in range(64):
        count = F.shiftrightunsigned(f"c{bit % 32}", bit // 32 * 32).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        print_ = print_.bitwiseOR(F.when(2 * count > F.col("n"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, print_.alias("print"))


def _block(print_: Column, k: int) -> Column:
    return F.shiftrightunsigned(print_, 8 * k).bitwiseAND(F.lit(0xFF).cast("long"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    words = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    return kept(words.select(
        F.monotonically_increasing_id().alias("item"), "item_id", F.size("w").alias("length"),
        shingle_hashes(F.col("w")).alias("hashes"), shingles_of(F.col("w")).alias("shingles")), "items")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
) -> DataFrame:
    """``doc_id, item_id, start, length, similarity``: the best window of each text for each item it contains.

    ``start`` counts words from 0.
    """
    items = _items(benchmark, item_col, item_text_col)
    # A shingle that an item repeats is lined up at its first place: the others only shift the same run.
    first = items.select("item", "length", F.posexplode("hashes").alias("at", "h")).groupBy("h", "item", "length").agg(F.min("at").alias("at"))
    placed = kept(first.groupBy("h").agg(F.collect_set(F.struct("length", "at")).alias("places")), "places")
    if (placed.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        placed = F.broadcast(placed)
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    shingled = rows.select("doc_id", F.xxhash64("w").alias("digest"), F.posexplode(shingle_hashes(F.col("w"))).alias("at_doc", "h"))
    met = shingled.join(placed, "h").select("doc_id", "digest", F.explode("places").alias("place"), "at_doc")
    windows = met.select("doc_id", "digest", (F.col("at_doc") - F.col("place.at")).alias("start"), F.col("place.length").alias("length")).distinct()
    windows = kept(windows, "windows")
    by_text = windows.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "length")).alias("windows"))
    cut = by_text.join(
        docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).withColumn("d", F.xxhash64("w")),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")),
    ).select("doc_id", "w", F.explode("windows").alias("x"))
    cut = cut.select("doc_id", F.greatest("x.start", F.lit(0)).alias("start"), F.col("x.length").alias("length"), F.slice(
        "w", F.greatest("x.start", F.lit(0)) + 1, F.least(F.col("x.length") + F.least("x.start", F.lit(0)), F.size("w"))).alias("part"))
    cut = kept(cut.withColumn("key", F.sha2(F.array_join("part", " "), 256)), "cut")
    unique = kept(cut.groupBy("key", "length").agg(F.first("part").alias("part")).withColumn("shingles", shingles_of(F.col("part"))), "unique")

    prints = simhash_of(unique.select("key", "length", F.explode(shingle_hashes(F.col("part"))).alias("h")), "key", "length")
    item_prints = simhash_of(items.select("item", "length", F.explode("hashes").alias("h")), "item", "length")
    masks = F.array(*(F.lit(m).cast("long") for m in ball_masks(8, RADIUS // BLOCKS)))
    filed = item_prints.select("item", F.col("length").alias("l"), F.col("print").alias("item_print"), F.explode(F.flatten(F.array(*(
        _ball(k, masks) for k in range(BLOCKS))))).alias("b"))
    looked_up = prints.select("key", "length", "print", F.explode(F.array(*(_block_key(F.col("print"), k) for k in range(BLOCKS)))).alias("b"))
    filed = filed.withColumnRenamed("b", "fb").hint("broadcast" if items.count() <= BROADCAST_ITEMS else "merge")
    near = looked_up.join(filed, (F.col("length") == F.col("l")) & (F.col("b") == F.col("fb")) & (distance(F.col("print"), F.col("item_print")) <= RADIUS))
    pairs = near.select("key", "length", "item").distinct()

    # Weighted Jaccard: the sum of the smaller counts over the sum of the larger ones.
    window_counts = pairs.join(unique.select("key", "length", "shingles"), ["key", "length"]).select(
        "key", "length", "item", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).groupBy("key", "length", "item", "n", "s").agg(F.count(F.lit(1)).alias("c"))
    item_counts = items.select("item", F.size("shingles").alias("m"), F.explode("shingles").alias("s")).groupBy("item", "m", "s").agg(F.count(F.lit(1)).alias("d"))
    common = window_counts.join(item_counts, ["item", "s"]).groupBy("key", "length", "item", "n", "m").agg(F.sum(F.least("c", "d")).alias("common"))
    score = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    verified = common.withColumn("similarity", score).filter(F.col("similarity") >= similarity).join(items.select("item", "item_id"), "item")
    found = cut.select("doc_id", "start", "length", "key").join(verified.select("key", "length", "item_id", "similarity"), ["key", "length"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "length")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), F.col("best.similarity").alias("similarity"))


def _block_key(print_: Column, k: int) -> Column:
    return _block(print_, k).bitwiseOR(F.lit(k << 8).cast("long"))


def _ball(k: int, masks: Column) -> Column:
    return F.transform(masks, lambda m: _block_key(F.col("print"), k).bitwiseXOR(m))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; a document of null id is never dropped."""
    found = find_contamination(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_hit")).filter("_hit is not null").distinct()
    return docs.join(found, docs[id_col] == F.col("_hit"), "left_anti")
