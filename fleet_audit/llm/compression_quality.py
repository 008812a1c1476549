"""Quality of texts by how well they compress against known good and known bad text.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad.
A text is compressed with either; the difference of the sizes over their sum says which it is
closer to. A logistic curve, fitted on labelled texts that went into neither dictionary, turns that
into the chance of label 1.

The model is fitted on a bounded sample of labelled texts (``SAMPLE_DOCS`` a label, texts of
``SAMPLE_CHARS`` characters at most); every text is scored whole. A null or empty text gets the
score the curve gives to a difference of zero. Rows of a document labelled both ways, and rows with
a null label, are not learned from. Repeated rows are each scored. Empty tables give no rows; with
no labels of one kind all scores are the share of the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of either kind that reach the driver, and the longest text among them.
SAMPLE_DOCS = 3_000
SAMPLE_CHARS = 20_000
#: Bytes of a dictionary, and of the pieces of a text that are compressed by themselves.
DICTIONARY_BYTES = 1 << 17
PIECE_BYTES = 1 << 7
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    #: log-odds of label 1 = ``intercept + slope * difference``.
    intercept: float
    slope: float


class _Sizer:
    """Compressed bytes of a text against one dictionary, piece by piece so that long texts keep the help of it."""

    def __init__(self, dictionary: bytes) -> None:
        data = zstandard.ZstdCompressionDict(dictionary)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), source_size=PIECE_BYTES, write_content_size=0, write_checksum=0, write_dict_id=0)
        data.precompute_compress(compression_params=params)
        self.compressor = zstandard.ZstdCompressor(dict_data=data, compression_params=params)

    def __call__(self, raw: bytes) -> int:
        return sum(len(self.compressor.compress(piece)) for piece in _pieces(raw))


def differences(texts: Iterator[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Positive where a text compresses better with the good dictionary; between -1 and 1."""
    if not good or not bad:
        return np.zeros(len(list(texts)))
    good_size, bad_size = _Sizer(good), _Sizer(bad)
    out = []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        a, b = good_size(raw), bad_size(raw)
        out.append((b - a) / (a + b) if raw else 0.0)
    return np.array(out)


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on the pieces of the sample texts; their plain content where there is too little to train on."""
    samples = [piece for text in texts for piece in _pieces(text.encode("utf-8", "surrogatepass"))]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 4)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight ridge on the slope, so that separable data stay finite."""
    intercept, slope, ridge = 0.0, 0.0, 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(intercept + slope * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([np.sum(y - p), np.sum((y - p) * x) - ridge * slope])
        hessian = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(hessian, gradient)
        intercept, slope = intercept + step[0], slope + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(intercept), float(slope)


def fit_quality(docs: DataFrame, labels: DataFrame, learn_from) -> QualityModel:
    """A model from the rows of ``docs`` (``doc_id, text``) that ``labels`` (``doc_id, quality``) names and ``learn_from`` admits."""
    clear = (
        labels.filter(learn_from & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .filter("quality = other").select("doc_id", "quality")
    )
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    chosen = [clear.filter(F.col("quality") == label).orderBy(order, "doc_id").limit(SAMPLE_DOCS) for label in (0, 1)]
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: str(r["doc_id"]))
    samples = {label: [r["text"] for r in found if r["quality"] == label] for label in (0, 1)}
    for_dictionary = {label: found[::2] for label, found in samples.items()}
    good, bad = _dictionary(for_dictionary[1]), _dictionary(for_dictionary[0])
    held_back = {label: found[1::2] for label, found in samples.items()}
    x = differences(iter(held_back[1] + held_back[0]), good, bad)
    y = np.array([1.0] * len(held_back[1]) + [0.0] * len(held_back[0]))
    if 0 < y.sum() < len(y):
        intercept, slope = _logistic(x, y)
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        intercept, slope = math.log(share / (1 - share)), 0.0
    return QualityModel(good, bad, intercept, slope)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", output_col: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1 for each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        odds = m.intercept + m.slope * differences(iter(texts), m.good, m.bad)
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    return docs.withColumn(output_col, score(F.col(text_col)))
