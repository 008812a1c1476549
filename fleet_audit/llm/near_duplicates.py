"""Near-duplicate classes of documents: SimHash links, and pairs that MinHashes bring together and their shingles confirm.

Two different texts are linked

* when their SimHash fingerprints lie within ``radius`` bits, found by multi-index hashing as in :mod:`fleet_audit.llm.simhash`, or
* when the Jaccard similarity of their sets of word shingles is ``similarity`` or more. Candidates share a band of MinHashes.

A band's texts meet its smallest one only. Texts that are then not of its class, as in a family of texts that share a passage, meet
once more in narrower bands, each put together of two; so a band of n texts gives some n pairs and never their square. A pair of similarity 0.8
shares none of 20 bands of four MinHashes once in 38,000 times. It is also missed when every narrower band that it shares has
a smallest text that both differ from; the tests measure the recall on such families.

A null text counts as empty. Texts without words are linked when their fingerprints are, which are all zero. Repeated rows are kept by the classes,
and one of them by ``drop_near_duplicates``. Rows of one id and different texts stay apart, and so do those of null id. Empty tables
give no rows. Other columns are kept by ``drop_near_duplicates``, whatever their names, and ignored by the classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.llm.components import connected_components
from fleet_audit.llm.hamming import hamming_links
from fleet_audit.llm.shared import kept, row_ids, unused
from fleet_audit.llm.simhash import SEED, fingerprint, shingle_bytes

#: Shingles that meet all MinHash functions at a time.
_HASHED = 1 << 12
#: Other bands that a band is joined with where its texts are not alike.
NARROWER = 4


def band_keys(text: str | None, words: int, bands: int, rows: int) -> list[int]:
    """A hash of each of ``bands`` bands of ``rows`` MinHashes over the set of shingles.

    Two texts agree in a MinHash as often as their shingle sets are similar, whatever kind of edit lies between them.
    """
    factors = np.random.default_rng(SEED).integers(1 << 63, size=(2, bands * rows, 1), dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for block in shingle_bytes(text, words):
        hashes = np.array([xxhash.xxh3_64_intdigest(s) for s in block], np.uint64)
        for k in range(0, len(hashes), _HASHED):
            least = np.minimum(least, (hashes[k : k + _HASHED] * (2 * factors[0] + 1) + factors[1]).min(axis=1))
    digests = [xxhash.xxh3_64_digest(band.tobytes(), t) for t, band in enumerate(least.reshape(bands, rows))]
    return np.frombuffer(b"".join(digests), ">i8").tolist()


def _distinct_texts(docs: DataFrame, row_col: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``node, text`` of every different text, a node being the smallest row of it, and ``row, id, node`` of every row."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = kept(docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), digest.alias("digest")), "digests")
    nodes = kept(rows.groupBy("digest").agg(F.min("row").alias("node")), "nodes")
    members = rows.join(nodes, "digest").select("row", "id", "node")
    texts = docs.select(F.col(row_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(nodes.select("node"), "node", "left_semi")
    return texts, members


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (``a, b``) whose texts have a Jaccard similarity of ``similarity`` or more over sets of shingles."""

    @F.pandas_udf("array<long>")
    def shingle_set(column: pd.Series) -> pd.Series:
        return pd.Series([
            np.unique(np.array([xxhash.xxh3_64_intdigest(s) for block in shingle_bytes(t, words) for s in block], np.uint64)).view(np.int64) for t in column
        ])

    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = kept(texts.join(named, "node", "left_semi").select("node", shingle_set("text").alias("s")), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def simhash_links(texts: DataFrame, words: int, radius: int) -> DataFrame:
    """``a, b``: links that connect the ``texts`` (``node, text``) whose fingerprints lie within ``radius`` bits."""

    @F.pandas_udf("long")
    def print_of(column: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in column], dtype="int64")

    prints = kept(texts.select("node", print_of("text").alias("print")), "prints")
    firsts = kept(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")), "distinct")
    same = prints.join(firsts.filter("n > 1"), "print").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = kept(hamming_links(firsts.select("print", "n"), radius).distinct(), "links")
    named = links.join(firsts.select(F.col("print").alias("a"), F.col("first").alias("fa")), "a").join(firsts.select(F.col("print").alias("b"), F.col("first").alias("fb")), "b")
    return same.unionByName(named.select(F.col("fa").alias("a"), F.col("fb").alias("b")))


def _met(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, node, centre`` of bands with more than one text, and the pairs ``a, b`` of centres and others."""
    ends = members.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last").select("key", "centre")
    shared = kept(members.join(ends, "key"), "bands")
    return shared, kept(shared.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")


def _strangers(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``shared`` that are not of the class of their band's centre."""
    named = shared.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(classes.select(F.col("node").alias("centre"), F.col("root").alias("of_centre")), "centre", "left")
    return named.filter(F.col("root") != F.coalesce("of_centre", "centre")).select("key", "band", "node")


def near_duplicate_classes(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, print_words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
    bands: int = 20, rows: int = 4, row_col: str = "_row",
) -> DataFrame:
    """``row, <id>, root, class_id`` per row of ``docs``: its class, and the smallest id in it.

    ``root`` tells classes apart, while rows of several classes may have one id or none. ``row_col`` is a number of its own for each row.
    """
    texts, members = _distinct_texts(docs, row_col, id_col, text_col)

    @F.pandas_udf("array<long>")
    def keys_of(column: pd.Series) -> pd.Series:
        return pd.Series([band_keys(t, words, bands, rows) for t in column])

    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    signed = kept(texts.filter(has_words).select("node", F.posexplode(keys_of("text")).alias("band", "key")), "signatures")
    shared, pairs = _met(signed)
    links = kept(simhash_links(texts, print_words, radius).unionByName(similar_pairs(pairs, texts, words, similarity)), "links")
    classes = kept(connected_components(links), "classes")

    apart = kept(_strangers(shared, classes), "apart")
    other = signed.join(apart.select("node").distinct(), "node", "left_semi").select("node", F.col("band").alias("other"), F.col("key").alias("with"))
    step = F.pmod(F.col("other") - F.col("band"), F.lit(bands))
    narrow = apart.join(other, "node").filter((step >= 1) & (step <= NARROWER))
    narrow = narrow.select("node", "band", F.xxhash64("key", "with", "other").alias("key"))
    _, closer = _met(narrow)
    closer = kept(closer.join(pairs, ["a", "b"], "left_anti"), "pairs")
    roots = connected_components(links.unionByName(similar_pairs(closer, texts, words, similarity)))
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("id").alias("class_id"))
    return placed.join(least, "root").select("row", F.col("id").alias(id_col), "root", "class_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, and of its rows the one read first."""
    row = unused(docs, "row")
    rows = row_ids(docs, "documents", row)
    classes = near_duplicate_classes(rows, words, similarity, id_col=id_col, text_col=text_col, row_col=row)
    keep = classes.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col), F.col("row"))).alias("first"))
    return rows.join(keep.select(F.col("first.row").alias(row)), row, "left_semi").drop(row)
