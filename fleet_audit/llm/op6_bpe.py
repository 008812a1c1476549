"""The registered query of :mod:`fleet_audit.llm.bpe`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.bpe import decode, encode
from fleet_audit.llm.shared import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, offsets=False).drop("text")
    digests = F.sha2(F.array_join("ids", " "), 256)
    return decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digests.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
