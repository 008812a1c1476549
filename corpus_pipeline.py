"""A training corpus from raw documents, stage by stage.

Each stage takes all that the one before kept, decides, and returns what is left; ``run`` writes each
result as Parquet and hands it on. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.bpe import decode, encode
from fleet_audit.llm.decontaminate import decontaminate
from fleet_audit.llm.line_dedup import dedup_lines
from fleet_audit.llm.compression_quality import score_quality
from fleet_audit.llm.op6_bpe import VOCABULARY
from fleet_audit.llm.op7_quality import fitted
from fleet_audit.llm.near_duplicates import drop_near_duplicates
from fleet_audit.llm.shared import kept, table, unused

#: Documents whose chance of a good label is lower are dropped.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier rejects. A null or empty text has no content and is dropped too.

    Repeated rows are scored alike, a null id is learned from like any other. An empty table gives no rows.
    """
    score = unused(docs, "score")
    scored = score_quality(docs, fitted(spark, docs, sf_dir), output_col=score)
    return scored.filter((F.col(score) >= LEAST_QUALITY) & (F.length("text") > 0)).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated multi-line chunks; a document of which nothing is left goes. ``n_chars`` follows the text.

    A null or empty text has no chunks and stays. Rows equal in id and text are one text and are cut alike; a null
    id comes behind all others. An empty table gives no rows.
    """
    removed = unused(docs, "removed")
    cut = dedup_lines(docs, removed_col=removed).filter((F.col(removed) == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).drop(removed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates.

    Groups are those of operator 8 (SimHashes of four-word shingles within four bits), joined by pairs whose sets of five-word
    shingles have a similarity of 0.8 or more. Null and empty texts are one group. A null id is kept only where a group has no
    other; of repeated rows one stays; one id may stay with different texts. An empty table gives no rows.
    """
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item. Null and empty texts contain none; an empty table gives no rows."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, kept only where decoding them gives the text back; a null or empty text has none.

    Repeated rows and null ids are kept. An empty table gives no rows.
    """
    path = public_tokenizers.path(VOCABULARY)
    encoded = encode(docs.select("doc_id", "text"), path, offsets=False)
    checked = decode(encoded, path).filter(F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"))
    return checked.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("tokens", tokens),
]

#: A trained classifier, SimHash and the merges of a vocabulary have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
