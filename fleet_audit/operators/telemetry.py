"""Look up, keep current, nest and follow up recorded queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleet_audit.functions.bounds import broadcast_if_small
from fleet_audit.functions.nesting import ROWS_PER_PART, nest_all
from fleet_audit.sources.stores import materialize

_QUERY = ["cluster", "query_id"]

#: Most bitmaps sent to every executor, of 4 KB for up to 32,768 rows of a file each.
MAX_BITMAPS = 16_384


def query_lookup(df: DataFrame, cluster: str, query_id: str) -> DataFrame:
    """Rows of one query; on a store partitioned by cluster only its directories are read."""
    return df.where((F.col("cluster") == cluster) & (F.col("query_id") == query_id))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The last capture of each query; repeats are thereby dropped.

    The ``= 1`` filter lets Spark keep one row per query in each task before the
    shuffle, so a query captured very often does not flood one task.
    """
    order = Window.partitionBy(*_QUERY).orderBy(*[F.desc(c) for c in ("captured_at", "snapshot_id") if c in snapshots.columns])
    return snapshots.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_documents(snapshots: DataFrame, placed: bool = False) -> DataFrame:
    """:func:`latest_snapshot` of a store with long documents: they are fetched after the choice is made.

    Rows are ranked by their keys and their place in the store's files, so no document is exchanged, and copies
    of one capture are one row. The chosen places go to where the documents lie, a bit for each row of a file; stores of
    very many files send the places themselves when they are few, and else join by them. ``snapshots``
    tells the places (:func:`fleet_audit.sources.stores.read_snapshots` with ``placed``); with ``placed`` the result does, too.
    """
    place, number = ["_file", "_row"], F.col("_row") + 1
    columns = [c for c in snapshots.columns if placed or c not in place]
    keys = [c for c in (*_QUERY, "captured_at", "snapshot_id") if c in snapshots.columns]
    chosen = latest_snapshot(snapshots.select(*keys, *place)).select(*place)
    bits = materialize(
        chosen.groupBy("_file", F.bitmap_bucket_number(number).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits")))
    if bits.count() > MAX_BITMAPS:
        return snapshots.join(broadcast_if_small(chosen), place, "left_semi").select(*columns)
    position = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = snapshots.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), ["_file", "_bucket"])
    return marked.where(F.getbit(byte, position % 8) == 1).select(*columns)


def query_report(
    tables: Mapping[str, DataFrame], rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Each query with its nested ``stages`` and ``operators``.

    A query with more than ``rows_per_part`` stages or operators continues in rows with
    a higher ``part``; every other query is one row.
    """
    kinds = {}
    for name, lead in (("stages", ["stage_id"]), ("operators", ["stage_id", "operator_id"])):
        rest = [c for c in tables[name].columns if c not in ("fleet", *_QUERY, *lead)]
        kinds[name] = (tables[name], F.struct(*lead, *rest))
    return (
        tables["query_info"].join(nest_all(kinds, _QUERY, rows_per_part), _QUERY, "left")
        .select(
            *_QUERY, F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"),
            "state", "elapsed_ms", "queued_ms", "peak_memory", "stages", "operators",
        )
    )


def fetch_if_fired(findings: DataFrame, rule_ids: list[str], detail: DataFrame, on: dict[str, str]) -> DataFrame:
    """Detail rows of what fired, such as the tasks of skewed stages.

    ``on`` maps columns of ``detail`` to finding columns (evidence fields by name). The
    fired keys are made distinct and counted: a small number is broadcast, so that the
    detail table is not shuffled, a large one is joined by key. Either way the semi join
    adds no rows. Give it findings that were written to a store.
    """
    fired = (
        findings.where(F.col("rule_id").isin(rule_ids))
        .select(*[
            F.col(source if source in findings.columns else f"evidence.{source}").alias(column)
            for column, source in on.items()
        ])
        .distinct()
    )
    return detail.join(broadcast_if_small(fired), list(on), "left_semi")
