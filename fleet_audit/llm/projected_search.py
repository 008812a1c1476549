"""Approximate nearest neighbours: stable projections in few dimensions, a kd-tree, and a chi-square stopping test.

Vectors are projected onto ``PROJECTED`` Gaussian directions. Gaussians are 2-stable: over the choice
of directions, the squared projected distance of two vectors is their squared distance times a
chi-square variable of ``PROJECTED`` degrees of freedom. A search takes projected neighbours from near
to far, verifies each by its true distance, and stops at a projected distance r once
``r^2 > chi2_q * d^2`` with d the k-th distance so far: a vector nearer than d would have shown up
before with probability ``CONFIDENCE``.

The kd-tree has two levels. Its top is fitted on a sample of at most ``SAMPLE`` projections and cuts
the data into cells, one group of rows each; below it every cell has a tree of its own. A query is first
answered in its own cell; the bound found there decides, by the same test on the cells' boxes, which
other cells it visits.

Equal vectors are one candidate that carries its smallest ids, so a vector that is very common costs
no more than another. Vectors null, empty, zero or with null or non-finite components take no part; vectors
of different length do not meet. Repeated rows count as candidates of the same id, but a query's own
id is never returned, and a repeated query is answered once. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleet_audit.llm.shared import kept

PROJECTED = 8
CONFIDENCE = 0.99
#: The chi-square quantile of that confidence for eight degrees of freedom.
CHI_SQUARE = 20.0902
#: Projections that the top of the tree is fitted on, and its most cells.
SAMPLE = 65_536
MAX_CELLS = 4_096
CELL_ROWS = 8_192
_LEAF = 256
_BLOCK = 128


def directions(dimensions: int) -> np.ndarray:
    return np.random.default_rng([7, dimensions]).standard_normal((dimensions, PROJECTED))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class KdTree:
    """A kd-tree over points, as the order of the points, the ends of its leaves and their boxes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        order, stack, leaves = np.arange(len(points)), [(0, len(points))], []
        while stack:
            first, last = stack.pop()
            part = points[order[first:last]]
            spread = part.max(axis=0) - part.min(axis=0) if last > first else np.zeros(points.shape[1])
            if last - first <= leaf or not spread.max() > 0:
                leaves.append((first, last))
                continue
            middle = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(part[:, spread.argmax()], middle)]
            stack += [(first, first + middle), (first + middle, last)]
        self.leaves = sorted(leaves)
        self.order = order
        self.low = np.array([points[order[a:b]].min(axis=0) for a, b in self.leaves])
        self.high = np.array([points[order[a:b]].max(axis=0) for a, b in self.leaves])

    def box_distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every leaf's box."""
        return box_distances(point, self.low, self.high)


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Splits ``(dimension, value, below, above)`` of the top tree; a negative child is the cell ``-1 - child``."""
    splits: list[tuple[int, float, int, int]] = []
    made = 0

    def build(points: np.ndarray, parts: int) -> int:
        nonlocal made
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if parts <= 1 or len(points) < 2 or not spread.max() > 0:
            made += 1
            return -made
        axis = int(spread.argmax())
        value = float(np.median(points[:, axis]))
        above = points[:, axis] > value
        if not above.any():
            value = float(np.max(points[points[:, axis] < value, axis]))
            above = points[:, axis] > value
        at = len(splits)
        splits.append((axis, value, 0, 0))
        splits[at] = (axis, value, build(points[~above], parts // 2), build(points[above], parts - parts // 2))
        return at

    build(sample, cells)
    return splits


def cells_of(points: np.ndarray, splits: list[tuple[int, float, int, int]]) -> np.ndarray:
    cell = np.zeros(len(points), np.int32)
    if not splits:
        return cell
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        axis, value, below, above = splits[node]
        right = points[rows, axis] > value
        for child, part in ((below, rows[~right]), (above, rows[right])):
            if child < 0:
                cell[part] = -1 - child
            elif len(part):
                todo.append((child, part))
    return cell


class _Cell:
    """The candidates of one cell and their tree."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], projections: np.ndarray) -> None:
        self.tree = KdTree(projections, _LEAF)
        order = self.tree.order
        self.vectors, self.projections = vectors[order], projections[order]
        self.sizes = np.array([len(ids[k]) for k in order])
        self.ends = np.cumsum(self.sizes)
        self.ids = np.array([i for k in order for i in ids[k]], np.int64)

    def search(self, query: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to ``k`` candidates nearer than ``bound`` (the k-th distance known elsewhere)."""
        far = self.tree.box_distances(point)
        leaves = np.argsort(far, kind="stable")
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        limit = bound
        rows, near = np.empty(0, np.int64), np.empty(0)
        for turn, leaf in enumerate(leaves):
            if far[leaf] > CHI_SQUARE * limit * limit:
                break
            first, last = self.tree.leaves[leaf]
            gap = self.projections[first:last] - point
            rows, near = np.concatenate((rows, np.arange(first, last))), np.concatenate((near, (gap * gap).sum(axis=1)))
            # Points nearer than the next box come next in projected order; those beyond the stopping distance never do.
            ahead = far[leaves[turn + 1]] if turn + 1 < len(leaves) else np.inf
            now = np.flatnonzero(near <= min(ahead, CHI_SQUARE * limit * limit))
            order = now[np.argsort(near[now], kind="stable")]
            later = (near > ahead) & (near <= CHI_SQUARE * limit * limit)
            ready, at_distance = rows[order], near[order]
            rows, near = rows[later], near[later]
            for start in range(0, len(ready), _BLOCK):
                if at_distance[start] > CHI_SQUARE * limit * limit:
                    break
                block = ready[start : start + _BLOCK]
                difference = self.vectors[block] - vector
                distance = np.sqrt((difference * difference).sum(axis=1))
                which = np.repeat(np.arange(len(block)), self.sizes[block])
                starts = self.ends[block] - self.sizes[block]
                at = np.repeat(starts - np.concatenate(([0], np.cumsum(self.sizes[block])[:-1])), self.sizes[block]) + np.arange(len(which))
                ids, own = self.ids[at], distance[which]
                other = ids != query
                best_ids, best = np.concatenate((best_ids, ids[other])), np.concatenate((best, own[other]))
                order = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[order], best[order]
                if len(best) == k:
                    limit = min(limit, best[-1])
        return best_ids, best


_FOUND = "query_id long, vec_id long, score double"


def _search_cells(rows: DataFrame, k: int) -> DataFrame:
    """Answers of the queries in each cell. ``rows``: ``cell, length, role`` (0 candidate, 1 query), ``id, ids, vector, projection, bound``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, cell = None, None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for r in batch.to_pylist():
                if (r["cell"], r["length"]) != key:
                    key, held, cell = (r["cell"], r["length"]), [], None
                vector, point = np.array(r["vector"], np.float64), np.array(r["projection"])
                if r["role"] == 0:
                    held.append((vector, r["ids"], point))
                    continue
                if cell is None and held:
                    cell = _Cell(np.stack([h[0] for h in held]), [h[1] for h in held], np.stack([h[2] for h in held]))
                    held = []
                if cell is not None:
                    ids, distances = cell.search(r["id"], vector, point, k, r["bound"])
                    out += zip([r["id"]] * len(ids), ids.tolist(), distances.tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    # The candidates of a cell come first, then its queries one by one, so a task holds one cell.
    return rows.repartition("cell", "length").sortWithinPartitions("cell", "length", "role").mapInArrow(run, _FOUND)


def _projected(vectors: DataFrame) -> DataFrame:
    """``vectors`` (with ``vector``) and their ``projection``."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("projection", T.ArrayType(T.DoubleType()))])
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [(np.array(v, np.float64) @ directions(len(v))).tolist() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points, pa.list_(pa.float64()))], [*names, "projection"])

    return vectors.mapInArrow(run, schema)


def _in_cells(rows: DataFrame, splits: list[tuple[int, float, int, int]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(splits)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = np.array(batch.column("projection").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of(points, sent.value), pa.int32())], [*names, "cell"])

    return rows.mapInArrow(run, schema)


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row that ``is_query`` admits."""
    spark = vectors.sparkSession
    usable = vectors.filter(F.col(id_col).isNotNull() & _usable(F.col(vector_col)))
    rows = usable.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    # The k + 1 smallest ids of each vector are enough, a query's own among them; tasks cut their copies before the shuffle.
    rank = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    few = rows.select("id", "vector").distinct().withColumn("r", rank).filter(F.col("r") <= k + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    candidates = kept(_projected(distinct.select("vector", "ids")), "projected")
    total = candidates.count()
    wanted = max(1, min(MAX_CELLS, SAMPLE // 8, total // CELL_ROWS))
    share = min(1.0, 0.9 * SAMPLE / max(1, total))
    chosen = candidates.select("projection").sample(share, seed=1).limit(SAMPLE)
    sample = np.array([r["projection"] for r in chosen.collect()]).reshape(-1, PROJECTED)
    splits = fit_cells(sample, wanted)
    cells = kept(_in_cells(candidates, splits).withColumn("length", F.size("vector")), "cells")
    queries = rows.filter("is_query").groupBy("id").agg(F.min("vector").alias("vector"))
    queries = kept(_in_cells(_projected(queries), splits).withColumn("length", F.size("vector")), "queries")

    filed = cells.select("cell", "length", F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), "ids", "vector", "projection", F.lit(None).cast("double").alias("bound"))
    at_home = queries.select("cell", "length", F.lit(1).alias("role"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "vector", "projection", F.lit(float("inf")).alias("bound"))
    first = kept(_search_cells(filed.unionByName(at_home), k), "found")

    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    bounded = queries.join(bounds, queries["id"] == bounds["query_id"], "left").select("id", "vector", "projection", "length", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    # At most MAX_CELLS boxes a length.
    axes = range(PROJECTED)
    boxes = cells.groupBy("cell", "length").agg(
        F.array(*(F.min(F.get("projection", F.lit(i))) for i in axes)).alias("low"), F.array(*(F.max(F.get("projection", F.lit(i))) for i in axes)).alias("high"))
    by_length: dict[int, list] = {}
    for b in boxes.collect():
        by_length.setdefault(b["length"], []).append((b["cell"], b["low"], b["high"]))
    sent = spark.sparkContext.broadcast({n: (np.array([c for c, _, _ in v]), np.array([w for _, w, _ in v]), np.array([h for _, _, h in v])) for n, v in by_length.items()})

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            at, to = [], []
            for i, (point, length, home, bound) in enumerate(zip(columns["projection"], columns["length"], columns["cell"], columns["bound"])):
                names, low, high = sent.value.get(length, (np.empty(0, int), np.empty((0, PROJECTED)), np.empty((0, PROJECTED))))
                near = names[box_distances(np.array(point), low, high) <= CHI_SQUARE * bound * bound]
                others = near[near != home].tolist()
                at += [i] * len(others)
                to += others
            if at:
                taken = batch.select(["id", "vector", "projection", "length", "bound"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *taken.columns], ["cell", "id", "vector", "projection", "length", "bound"])

    kind = cells.schema["vector"].dataType.simpleString()
    away = bounded.mapInArrow(visits, f"cell int, id long, vector {kind}, projection array<double>, length int, bound double")
    away = away.select("cell", "length", F.lit(1).alias("role"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "vector", "projection", "bound")
    found = first.unionByName(_search_cells(filed.unionByName(away), k)) if len(by_length) and sum(map(len, by_length.values())) > 1 else first
    order = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
