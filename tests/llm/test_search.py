"""Nearest neighbours against a full search."""

import numpy as np
from pyspark.sql import functions as F

from fleet_audit.llm import projected_search
from fleet_audit.llm.projected_search import nearest_vectors

NAN = float("nan")


def full_search(rows, k):
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % 5 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in usable if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(120)] + [(200 + i, [1.0] * 12) for i in range(40)]
    rows += [(500, None), (505, []), (510, [0.0] * 12), (515, [1.0, NAN] + [0.0] * 10), (520, [1.0, None] + [0.0] * 10), (525, [1.0, 2.0]), (530, [1.0, 3.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = nearest_vectors(df, F.col("vec_id") % 5 == 0, k=10).orderBy("query_id", "rank").collect()
    want = full_search(rows, 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = sum(len({i for _, i in want[q]} & {i for _, i in found.get(q, [])}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for _, i in found[200]] == [i for _, i in want[200]]
    assert found[525] == [(1.0, 530)] == want[525]
    assert set(found) <= set(want)


def test_many_cells_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(projected_search, "CELL_ROWS", 100)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) + 3 * (i % 7)).tolist()) for i in range(1500)]
    got = nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=10).collect()
    want = {q: v for q, v in full_search(rows, 10).items() if q % 100 == 0}
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hits >= 0.9 * 150 and len(got) == 150


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_vectors(empty, F.col("vec_id") % 100 == 0).collect() == []
