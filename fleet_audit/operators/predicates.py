"""How a scan filters its partition column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOT_A_CALL = r"(?!(?:in|and|or|not|any|all|some|exists|between|on|where|when|then|else)\b)"


def classify_predicate(scans: DataFrame) -> DataFrame:
    """Add ``predicate_class``: wrapped_predicate, no_predicate or other.

    A predicate wraps the column when a function call or cast has it among its
    arguments, which hides it from partition pruning.
    """
    predicate, name = F.col("predicate"), F.col("partition_column")
    column = F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b"))
    call = F.concat(F.lit(r"(?is)\b" + _NOT_A_CALL + r"[a-z_]\w*\s*\([^()]*"), column)
    # Plain text searches spare most rows the regular expressions.
    mentioned = F.contains(F.lower(predicate), F.lower(name)) & F.regexp_like(predicate, F.concat(F.lit("(?is)"), column))
    wrapped = F.contains(predicate, F.lit("(")) & F.regexp_like(predicate, call)
    return scans.withColumn(
        "predicate_class",
        F.when(F.coalesce(~mentioned, F.lit(True)), "no_predicate").when(wrapped, "wrapped_predicate").otherwise("other"),
    )
