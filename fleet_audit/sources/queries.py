"""Saved query documents (JSON) and exports of the runtime tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.functions.text import data_bytes, duration_ms
from fleet_audit.functions.versions import version_array
from fleet_audit.operators.telemetry import latest_documents
from fleet_audit.sources.stores import materialize

_KEYS = ("fleet", "cluster", "query_id")

#: All stages of a document, however deep they are nested; see :func:`stage_rows`.
STAGES = "stages"
_TOP_STAGES, _ROOT_STAGES, _SUB_STAGES = ("$.stages", "$.stages.stages"), ("$.outputStage", "$.output_stage"), ("$.subStages", "$.sub_stages")

#: Arrays to walk through to reach the rows of a table, outermost first; each with the paths it may have.
ARRAYS = {
    "query_info": (),
    "stages": (STAGES,),
    "tasks": (STAGES, ("$.tasks",)),
    "operators": (STAGES, ("$.operators", "$.stageStats.operatorSummaries")),
    "scans": (("$.scans",),),
    "scan_files": (("$.scans",), ("$.files",)),
    "dynamic_filters": (("$.dynamic_filters", "$.queryStats.dynamicFiltersStats.dynamicFilterDomainStats"),),
}

#: Tables that several detectors read, or one of them more than once.
READ_OFTEN = ("operators", "scans", "tasks")

#: The only place that knows the shape of a document: table, field, level, paths, kind. Level 0 is the document, 1 an
#: element of the outer array, 2 of the inner one; the first path that has a value counts. A duration
#: (``ms``, ``fine_ms``) or an amount of data (``bytes``) may be a number or a text with its unit.
PATH_MAP = (
    ("query_info", "state", 0, ("$.state",), "string"),
    ("query_info", "elapsed_ms", 0, ("$.elapsed_ms", "$.queryStats.elapsedTime"), "ms"),
    ("query_info", "queued_ms", 0, ("$.queued_ms", "$.queryStats.queuedTime"), "ms"),
    ("query_info", "peak_memory", 0, ("$.peak_memory", "$.queryStats.peakUserMemoryReservation"), "bytes"),
    ("stages", "stage_id", 1, ("$.stage_id", "$.stageId"), "string"),
    ("stages", "wall_ms", 1, ("$.wall_ms", "$.stageStats.totalScheduledTime"), "fine_ms"),
    ("stages", "input_rows", 1, ("$.input_rows", "$.stageStats.processedInputPositions"), "long"),
    ("stages", "output_rows", 1, ("$.output_rows", "$.stageStats.outputPositions"), "long"),
    ("tasks", "stage_id", 1, ("$.stage_id", "$.stageId"), "string"),
    ("tasks", "task_id", 2, ("$.task_id", "$.taskStatus.taskId"), "string"),
    ("tasks", "wall_ms", 2, ("$.wall_ms", "$.stats.elapsedTime"), "fine_ms"),
    ("operators", "stage_id", 1, ("$.stage_id", "$.stageId"), "string"),
    ("operators", "operator_id", 2, ("$.operator_id", "$.operatorId"), "string"),
    ("operators", "operator", 2, ("$.operator", "$.operatorType"), "string"),
    ("operators", "input_rows", 2, ("$.input_rows", "$.inputPositions"), "long"),
    ("operators", "output_rows", 2, ("$.output_rows", "$.outputPositions"), "long"),
    ("operators", "build_bytes", 2, ("$.build_bytes",), "bytes"),
    ("operators", "spilled_bytes", 2, ("$.spilled_bytes", "$.spilledDataSize"), "bytes"),
    ("scans", "table_id", 1, ("$.table",), "string"),
    ("scans", "part", 1, ("$.partition",), "string"),
    ("scans", "partition_column", 1, ("$.partition_column",), "string"),
    ("scans", "predicate", 1, ("$.predicate",), "string"),
    ("scan_files", "table_id", 1, ("$.table",), "string"),
    ("scan_files", "file_id", 2, ("$.path",), "string"),
    ("scan_files", "bytes", 2, ("$.bytes",), "bytes"),
    ("dynamic_filters", "filter_id", 1, ("$.id", "$.dynamicFilterId"), "string"),
    ("dynamic_filters", "input_rows", 1, ("$.input_rows",), "long"),
    ("dynamic_filters", "output_rows", 1, ("$.output_rows",), "long"),
)

# Kinds with a unit: the type of the result and how a text is read.
_WITH_UNIT = {"ms": ("long", duration_ms), "fine_ms": ("double", duration_ms), "bytes": ("long", data_bytes)}


def read_query_documents(spark: SparkSession, path: str, cluster: str | None = None) -> DataFrame:
    """JSON files, one query document each: ``fleet, cluster, query_id, captured_at, snapshot_id, document``.

    The file name without extension is the query id; the document may name its fleet and its cluster.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?$", 1)
    stated = F.get_json_object("value", "$.cluster")
    return spark.read.format("text").option("wholetext", True).load(path).select(
        F.get_json_object("value", "$.fleet").alias("fleet"),
        F.coalesce(stated, F.lit(cluster)).alias("cluster"),
        F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("query_id"),
        F.col("_metadata.file_modification_time").alias("captured_at"),
        F.unix_micros(F.col("_metadata.file_modification_time")).alias("snapshot_id"),
        F.col("value").alias("document"),
    )


def parse_snapshots(records: DataFrame) -> DataFrame:
    """Replace ``document`` text by ``body`` VARIANT; documents that are no JSON are left out.

    A filter on ``body`` would be pushed below it and make and parse each document twice; an array without its nulls is made once.
    """
    parsed = F.filter(F.array(F.try_parse_json("document")), lambda body: body.isNotNull())
    return records.withColumn("body", F.explode(parsed)).drop("document")


def _may_nest(document: Column) -> Column:
    """Whether a text may list stages below a stage: a key says so, or an escape might hide one."""
    marks = [*(path.removeprefix("$.") for path in _SUB_STAGES), r"\u"]
    return reduce(Column.__or__, [F.contains(document, F.lit(mark)) for mark in marks])


def parsed_documents(records: DataFrame) -> DataFrame:
    """``body`` (VARIANT) of the last capture of each query with its keys, written once; documents that are no JSON are left out.

    ``nests`` tells which of them may have stages below stages. Records that tell their place in a store
    (:func:`fleet_audit.sources.stores.read_snapshots` with ``placed``) are chosen there, and only chosen ones are parsed; others are parsed and
    written first and chosen among what was written, so no document is exchanged.
    """
    nests = _may_nest(F.col("document")).alias("nests")
    keys = [F.col(k) if k in records.columns else F.lit(None).cast("string").alias(k) for k in _KEYS]
    if "captured_at" not in records.columns or "_row" in records.columns:
        last = latest_documents(records) if "captured_at" in records.columns else records
        return materialize(parse_snapshots(last.select(*keys, "document", nests)))
    times = [c for c in ("captured_at", "snapshot_id") if c in records.columns]
    # The last capture counts although it cannot be read, so those stay until the choice is made.
    written = materialize(records.select(*keys, *times, F.try_parse_json("document").alias("body"), nests), placed=True)
    return latest_documents(written).where("body is not null").drop(*times)


def bad_documents(records: DataFrame) -> DataFrame:
    """The records :func:`parse_snapshots` leaves out, text kept."""
    return records.where(F.try_parse_json("document").isNull())


def _first_array(variant: Column, paths: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_variant_get(variant, path, "array<variant>") for path in paths])


def _value(variant: Column, paths: Sequence[str], kind: str) -> Column:
    if kind not in _WITH_UNIT:
        return F.coalesce(*[F.try_variant_get(variant, path, kind) for path in paths])
    result, read = _WITH_UNIT[kind]
    texts = [read(F.try_variant_get(variant, path, "string")) for path in paths]
    whole = [F.round(t).try_cast(result) for t in texts] if result == "long" else texts
    return F.coalesce(*[x for path, text in zip(paths, whole) for x in (F.try_variant_get(variant, path, result), text)])


def stage_rows(snapshots: DataFrame) -> DataFrame:
    """Every stage of every document: the keys, ``stage_path``, ``depth``, ``parent_stage_id`` and ``stage`` (VARIANT).

    A document lists its stages, or nests them below its output stage; both are found. Nested stages are taken level by
    level until a level has none; each level is written once, so the work is that of the documents and not of their depth squared.
    Where ``snapshots`` tell which documents may nest (:func:`parsed_documents`), others are not looked at again.
    ``stage_path`` counts places from the top, such as ``0.2.1``.
    """
    keys = [c for c in _KEYS if c in snapshots.columns]
    body = F.col("body")
    stated = [F.try_variant_get(body, path, "variant") for path in _ROOT_STAGES]
    root = F.coalesce(*[F.when(~F.is_variant_null(stage), stage) for stage in stated])
    listed = F.coalesce(_first_array(body, _TOP_STAGES), F.array().cast("array<variant>"))
    tops = F.when(root.isNotNull(), F.concat(listed, F.array(root))).otherwise(listed)
    columns = [*keys, "stage_path", "depth", "parent_stage_id", "stage"]

    def top(documents: DataFrame) -> DataFrame:
        return documents.select(*keys, F.posexplode(tops).alias("place", "stage")).select(
            *keys, F.col("place").cast("string").alias("stage_path"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_stage_id"), "stage")

    found = [top(snapshots)]
    level = top(snapshots.where("nests")) if "nests" in snapshots.columns else found[0]
    has_more = _first_array(F.col("stage"), _SUB_STAGES).isNotNull().alias("nests")
    own_id = _value(F.col("stage"), ("$.stage_id", "$.stageId"), "string")
    while True:
        inner = level.select(*keys, "stage_path", "depth", own_id.alias("parent"), F.posexplode(_first_array(F.col("stage"), _SUB_STAGES)).alias("place", "stage"))
        below = materialize(inner.select(
            *keys, F.concat_ws(".", "stage_path", F.col("place").cast("string")).alias("stage_path"), (F.col("depth") + 1).alias("depth"), F.col("parent").alias("parent_stage_id"), "stage", has_more))
        if below.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(below.select(*columns))
        level = below.where("nests")


def flatten_query(
    snapshots: DataFrame, table: str, path_map: Sequence[tuple] = PATH_MAP, stages: DataFrame | None = None, placed: bool = False
) -> DataFrame:
    """One flat table (a key of :data:`ARRAYS`) out of all query documents.

    Documents are exploded where they lie; nothing is shuffled. Missing fields are NULL. ``stages`` are the :func:`stage_rows` of
    the documents, where they are known already; with ``placed`` tables of stages also tell where a stage stands.
    """
    fields = [(f, level, (paths,) if isinstance(paths, str) else paths, kind) for t, f, level, paths, kind in path_map if t == table]
    if not fields:
        raise ValueError(f"no such table: {table}")
    keys, arrays = [c for c in _KEYS if c in snapshots.columns], ARRAYS[table]
    extra: list[str] = []
    if arrays[:1] == (STAGES,):
        extra = ["stage_path", "depth", "parent_stage_id"] if placed else []
        frame = (stage_rows(snapshots) if stages is None else stages).select(*keys, *extra, F.col("stage").alias("_level1"))
        arrays, start = arrays[1:], 2
    else:
        frame, start = snapshots.select(*keys, F.col("body").alias("_level0")), 1
    for depth, paths in enumerate(arrays, start):
        frame = frame.withColumn(f"_level{depth}", F.explode(_first_array(F.col(f"_level{depth - 1}"), paths)))
    return frame.select(*keys, *extra, *[_value(F.col(f"_level{level}"), paths, kind).alias(f) for f, level, paths, kind in fields])


def flat_tables(records: DataFrame, written: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All flat tables of a set of saved documents, from the last capture of each query; keys a document lacks are NULL.

    Documents are parsed once, and the parsed ones written, for all tables. A table is taken out of them whenever it is read; those named in
    ``written`` once, for callers that read them several times.
    """
    parsed = parsed_documents(records)
    stages = stage_rows(parsed)
    tables = {table: flatten_query(parsed, table, stages=stages) for table in ARRAYS}
    return {table: materialize(frame) if table in written else frame for table, frame in tables.items()}


def tables_to_judge(records: DataFrame) -> dict[str, DataFrame]:
    """:func:`flat_tables` for the detectors."""
    return flat_tables(records, READ_OFTEN)


def read_runtime_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Exports of the runtime tables: ``<path>/queries``, ``tasks`` and ``nodes`` (parquet)."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("queries", "tasks", "nodes")}


def fill_from_runtime(query_info: DataFrame, runtime_queries: DataFrame) -> DataFrame:
    """Take from the runtime table what the saved document lacks; no row is added."""
    fields = [c for c in ("state", "elapsed_ms", "queued_ms", "peak_memory") if c in runtime_queries.columns]
    extra = runtime_queries.groupBy("cluster", "query_id").agg(*[F.max(f).alias(f"_{f}") for f in fields])
    joined = query_info.join(extra, ["cluster", "query_id"], "left")
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in query_info.columns
    ])


def merge_tasks(tasks: DataFrame, runtime_tasks: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Tasks of documents and of the runtime table in one, field by field: ``tasks`` with ``node, node_version, seen_in``.

    A task is the same when cluster, query, stage and task id are. The document, written when the query was over, decides; the
    runtime table supplies what it lacks, and tasks that no document lists (of a query still running, or cut from
    its document). ``seen_in`` is ``document``, ``runtime`` or ``both``. ``nodes`` (``cluster, node, node_version``) tells
    where a task ran on what; a node listed twice counts once, with its greatest version. Sources are aggregated by task before they meet,
    so a task listed twice stays one row.
    """
    keys = ["cluster", "query_id", "stage_id", "task_id"]

    def side(df: DataFrame, rank: int) -> DataFrame:
        text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        return df.select(*keys, text("fleet").alias("fleet"), text("node").alias("node"), F.col("wall_ms").cast("double").alias("wall_ms"), F.lit(rank).alias("rank"))

    both = side(tasks, 0).unionByName(side(runtime_tasks, 1))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rank", F.col(c).alias("v")))).getField("v")
    merged = both.groupBy(*keys).agg(
        first("fleet").alias("fleet"), first("wall_ms").alias("wall_ms"), first("node").alias("node"),
        F.when(F.min("rank") == F.max("rank"), F.when(F.min("rank") == 0, "document").otherwise("runtime")).otherwise("both").alias("seen_in"))
    if nodes is None:
        return merged.withColumn("node_version", F.lit(None).cast("string"))
    listed = nodes.groupBy("cluster", "node").agg(F.max(F.struct(version_array(F.col("node_version")), "node_version")).getField("node_version").alias("node_version"))
    return merged.join(listed, ["cluster", "node"], "left")
