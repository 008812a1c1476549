"""Tables beside the query documents, keyed by the table they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame

REFERENCES = ("column_stats", "table_files")


def table_keys(reference: DataFrame) -> list[str]:
    """Columns that name a table: with its cluster, where the reference tells clusters apart."""
    return ["cluster", "table_id"] if "cluster" in reference.columns else ["table_id"]
