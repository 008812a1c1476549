"""Shards: equal counts, gapless slots, groups together, groups larger than a shard in as few as needed."""

import collections
import zlib

from fleet_audit.llm.balanced_shards import balanced_shards, cut_links


def check(rows, shards, docs):
    counts = collections.Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1
    for shard in range(shards):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts.get(shard, 0)))


def test_groups_stay_together(spark):
    texts = [f"alone {i}" for i in range(150)] + [f"pair {i // 2}" for i in range(80)] + [f"four {i // 4}" for i in range(40)] + [None, None, "", "", ""]
    docs = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(5, "alone 5", "x")]
    placed = balanced_shards(spark.createDataFrame(docs, "doc_id long, text string, shard string"), 10)
    rows = placed.collect()
    check(rows, 10, docs)
    where = collections.defaultdict(set)
    for r in rows:
        where[r.grp].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert cut_links(placed).first()["cut"] == 0
    sizes = {(r.size, r.crc) for r in rows}
    assert sizes == {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts}


def test_a_group_larger_than_a_shard(spark):
    docs = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(600)]
    rows = balanced_shards(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()
    check(rows, 12, docs)
    hot = collections.Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert len(hot) <= 6


def test_few_and_no_rows(spark):
    rows = balanced_shards(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"), 40).collect()
    check(rows, 40, [1, 2])
    assert balanced_shards(spark.createDataFrame([], "doc_id long, text string"), 40).collect() == []
