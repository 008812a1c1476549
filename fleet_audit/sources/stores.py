"""Our own stores: saved query documents and audit results."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleet_audit import schemas


_LOCAL: list[str] = []
# Hidden from a listing of the store itself.
_COMPACTED, _MANIFEST = "_compacted", "_manifest"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that runs in one process may do without: it uses a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/fleet-audit-{uuid.uuid4().hex}"


def materialize(df: DataFrame, placed: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results used several times: they are computed once, their lineage ends, and a
    lost executor costs one read. With ``placed`` each row tells its ``_file`` and its ``_row`` in it.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select("*", *(_place() if placed else []))


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def write_snapshots(snapshots: DataFrame, path: str, gathered: bool = False) -> None:
    """Append saved query documents, by cluster and day of capture.

    ``rebalance`` gives each directory few, evenly sized files and splits a cluster or
    day that holds a large share of all rows over several tasks. Snapshots that are ``gathered``, so that few clusters are in
    a task already, are written where they are and no document is exchanged.
    """
    dated = snapshots.withColumn("day", F.to_date("captured_at"))
    arranged = dated if gathered else dated.hint("rebalance", "cluster", "day")
    arranged.write.mode("append").option("compression", "zstd").partitionBy("cluster", "day").parquet(path)


def read_snapshots(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """The snapshot store; a filter on cluster or day prunes directories.

    Cluster names stay text, whatever they look like. Files that a finished compaction has merged are read in their merged form; an
    unfinished one is not seen. With ``placed`` each row tells its ``_file`` and its ``_row`` in it.
    """
    files, generations = _live(spark, path)
    place = _place() if placed else []
    parts = [_stored(spark, [f"{path}/{_COMPACTED}/{g}"], f"{path}/{_COMPACTED}/{g}").select("*", *place) for g in generations]
    if files or not parts:
        parts.append(_stored(spark, files if generations else [path], path).select("*", *place))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _stored(spark: SparkSession, paths: list[str], base: str) -> DataFrame:
    reader = spark.read.option("basePath", base)
    found = reader.parquet(*paths).schema
    named = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "cluster" else f for f in found.fields])
    return spark.read.option("basePath", base).schema(named).parquet(*paths)


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, on whatever file system they lie."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found]


def _live(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files of the store that no compaction has merged, and the generations that hold the merged ones.

    Only names of files reach the driver, as they do for every listing.
    """
    done = sorted(p.split("/")[-2] for p in _listed(spark, f"{path}/{_MANIFEST}/*/_SUCCESS"))
    if not done:
        return [], []
    merged = spark.read.schema("name string, generation boolean").parquet(*[f"{path}/{_MANIFEST}/{g}" for g in done]).collect()
    gone = {r["name"] for r in merged}
    listed = spark.read.parquet(path).inputFiles() if _listed(spark, f"{path}/cluster=*") else []
    return [f for f in listed if f not in gone], [g for g in done if g not in gone]


def compact_snapshots(spark: SparkSession, path: str, files_per_directory: int = 1, everything: bool = False) -> str | None:
    """Merge the small files of the store: at most ``files_per_directory`` files per cluster and day. The name of the new generation.

    The files are merged into a new generation first, and then a manifest names what it replaces; the manifest
    counts once Spark has committed it. Readers therefore see the old files or the new ones and never both, and a job that is stopped
    midway changes nothing. Files that arrive meanwhile are not among those listed and stay as they are. ``everything`` also merges
    earlier generations. Replaced files are not deleted, since a reader may still hold them.
    """
    files, generations = _live(spark, path)
    if not generations:
        files = spark.read.parquet(path).inputFiles()
    replaced = [(f, False) for f in files] + [(g, True) for g in generations if everything]
    if not files and len(replaced) < 2:
        return None
    parts = [_stored(spark, files, path)] if files else []
    parts += [_stored(spark, [f"{path}/{_COMPACTED}/{g}"], f"{path}/{_COMPACTED}/{g}") for g in generations if everything]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    salt = F.pmod(F.xxhash64("query_id", "captured_at"), F.lit(files_per_directory))
    name = f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    rows.repartition("cluster", "day", salt).write.partitionBy("cluster", "day").parquet(f"{path}/{_COMPACTED}/{name}")
    spark.createDataFrame(replaced, "name string, generation boolean").coalesce(1).write.parquet(f"{path}/{_MANIFEST}/{name}")
    return name


def write_findings(findings: DataFrame, path: str, run_id: str) -> None:
    """Append the findings of one run; reading one run prunes to its directory."""
    (
        findings.withColumn("run_id", F.lit(run_id))
        .hint("rebalance")
        .write.mode("append").partitionBy("run_id").parquet(path)
    )


def read_findings(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.schema(f"{schemas.FINDINGS}, run_id string").parquet(path).where(F.col("run_id") == run_id)
