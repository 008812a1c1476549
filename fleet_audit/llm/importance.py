"""Importance resampling towards the distribution of a target corpus.

A text's features are its runs of words (:mod:`fleet_audit.llm.word_runs`), hashed into buckets. A bucket's gain is the logarithm
of its share in the target over its share in the documents, smoothed by one per bucket, in whole thousandths. A document's weight is
the mean gain of its features; Gumbel noise drawn from its id makes of the weight a score, and the highest scores
are a sample without replacement in proportion to the weights. Scores are ranked by :mod:`fleet_audit.llm.radix_sort`.

Bucket counts cover all texts of both tables. A task adds up an array of counts and gives it once; gains are an array of
constant size. Weights are read off that array for whole columns of texts.

A null text is empty: no features, weight 0. A null id draws its noise as empty text and comes behind all ids
in a tie. Rows of one id and score take ranks next to each other. Repeated rows are rows of their own. An empty target
gives every bucket the share of its smoothing; empty documents give no rows. Other columns are ignored
by ``importance_ranks`` and kept by ``resample``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.llm.radix_sort import radix_ranks
from fleet_audit.llm.shared import kept, row_ids, unused
from fleet_audit.llm.word_runs import run_buckets

BUCKETS = 10_000
LONGEST_RUN = 2


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> dict[int, int]:
    """How many features of ``texts`` fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in run_buckets(batch.column(0), longest, buckets):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    found = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    return [
        math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all) / (float(corpus.get(b, 0) + 1) * float(t_all)))) for b in range(buckets)
    ]


def noise(id_text: str, seed: int) -> int:
    """Gumbel noise in thousandths, the same for an id wherever it stands."""
    h = int(hashlib.sha256(f"{seed}:{id_text}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: list[int], seed: int, id_col: str, text_col: str, longest: int = LONGEST_RUN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``<id>, *keep, n_words, n_features, weight, score`` of each row."""
    array = np.array(gains, np.float64)
    names = [id_col, *keep, "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            for texts, lengths, found in run_buckets(batch.column(text_col), longest, len(array)):
                words += np.bincount(texts[lengths == 1], minlength=rows)
                features += np.bincount(texts, minlength=rows)
                total += np.bincount(texts, weights=array[found], minlength=rows)  # whole numbers below 2**53
            weight = np.where(features > 0, total.astype(np.int64) // np.maximum(features, 1), 0)
            ids = batch.column(id_col)
            noises = np.array([noise("" if i is None else str(i), seed) for i in ids.to_pylist()], np.int64)
            out = [ids, *(batch.column(c) for c in keep), *map(pa.array, (words, features, weight, weight + noises))]
            yield pa.RecordBatch.from_arrays(out, names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (id_col, *keep)), *(f"{c} long" for c in names[-4:])])
    return docs.select(id_col, *keep, text_col).mapInArrow(run, schema)


def importance_ranks(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``<id>, *keep, n_features, weight, score, rank`` of each row of ``docs``; ``rank`` is null for what is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred are drawn: the highest scores, ties to smaller ids.
    """
    gains = gains_of(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    rows = kept(scored(docs, gains, seed, id_col, text_col, keep=keep), "scored")
    shown = [id_col, *keep, "n_features", "weight", "score"]
    eligible = F.col("n_words") >= least_words
    sortable = rows.filter(eligible).select(
        *shown, (-F.col("score")).alias("_by_score"), F.col(id_col).isNull().cast("long").alias("_unknown"), F.coalesce(id_col, F.lit(0)).cast("long").alias("_by_id"))
    ranked = radix_ranks(sortable, ["_by_score", "_unknown", "_by_id"])
    drawn = rows.filter(eligible).count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.select(*shown, rank.alias("rank")).unionByName(rows.filter(~eligible).select(*shown, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, rank_col: str = "rank", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, all their columns, with their rank; a column named ``rank_col`` is replaced."""
    row = unused(docs, "row")
    rows = row_ids(docs.drop(rank_col), "documents", row)
    ranks = importance_ranks(rows, target, percent, id_col=id_col, text_col=text_col, keep=(row,), **options)
    drawn = ranks.filter("rank is not null").select(F.col(row), F.col("rank").alias(rank_col))
    return rows.join(drawn, row).drop(row)
