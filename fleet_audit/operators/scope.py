"""Which configuration domains a question is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_audit.functions.bounds import bounded_rows


def resolve_scope(questions: DataFrame, scope_map: DataFrame, text: str = "question") -> DataFrame:
    """Add ``scopes``, ``confidence`` and ``all_scopes`` to every question.

    Signals are a bounded list and become one column expression each: no join, no
    shuffle, one pass over any number of questions. Confidence is the share of signals
    that hit. A question without a hit gets no scopes, and the full list to pick from.
    """
    signals = bounded_rows(scope_map, "the scope map")
    everything = sorted({scope for row in signals for scope in row.scopes})
    none = F.array().cast("array<string>")
    hits = [
        (F.col(text).rlike(f"(?is)\\b(?:{row.signal})"), F.array(*[F.lit(s) for s in row.scopes]))
        for row in signals
    ]
    scopes = F.array_sort(F.array_distinct(F.flatten(F.array(
        *[F.when(hit, values).otherwise(none) for hit, values in hits]
    ))))
    share = sum((F.when(hit, 1.0).otherwise(0.0) for hit, _ in hits), F.lit(0.0)) / len(hits)
    return questions.withColumns({
        "scopes": scopes,
        "confidence": share,
        "all_scopes": F.when(F.size(scopes) == 0, F.array(*[F.lit(s) for s in everything])).otherwise(none),
    })
