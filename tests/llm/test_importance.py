"""Importance resampling against a plain reading of its definition, and the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleet_audit.llm import radix_sort, word_runs
from fleet_audit.llm.importance import importance_ranks, resample
from fleet_audit.llm.radix_sort import radix_ranks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abAB09 é漢.,_-\n\x7fİ", k=rng.randrange(60))) for _ in range(n)]
    return texts + [None, "", "x" * 100 + " " + "é" * 50 + " z", "ABC", "def", "!"]


@pytest.mark.parametrize("block", [7, 64, 1 << 21])
def test_buckets_of_runs(monkeypatch, block):
    monkeypatch.setattr(word_runs, "BLOCK_BYTES", block)
    texts = odd_texts(200)
    found = Counter()
    for rows, _, buckets in word_runs.run_buckets(pa.array(texts).slice(3), 2, 997):
        found.update(zip(rows.tolist(), buckets.tolist()))
    assert found == Counter((k, zlib.crc32(f.encode()) % 997) for k, t in enumerate(texts[3:]) for f in features(t)[1])


def slow_ranks(docs, target, percent=25, least=20, seed=7):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = counts(d[1] for d in docs), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: percent * len(order) // 100]
    return Counter((*r[:4], k + 1 if k < len(drawn) else None) for k, r in enumerate(order)) + Counter((*r[:4], None) for r in rows if not r[4])


def test_ranks_follow_the_definition(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["Élan", "漢字", "x-y"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for k in range(120)]
    docs += [(500, None), (501, ""), (None, " ".join(vocabulary[:30])), (None, None), (7, docs[7][1]), (-3, docs[7][1]), (1 << 40, "A " * 25)]
    target = [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = importance_ranks(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == slow_ranks(docs, target)


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more " * 9, k, "own", 1) for k in range(8)], "doc_id long, text string, rank int, `row` string, score int")
    none = docs.limit(0)
    assert importance_ranks(none, docs).collect() == []
    assert importance_ranks(docs, none).count() == 8
    drawn = resample(docs, docs, percent=50)
    assert drawn.columns == ["doc_id", "text", "row", "score", "rank"]
    assert sorted(r["rank"] for r in drawn.collect()) == [1, 2, 3, 4] and {r["row"] for r in drawn.collect()} == {"own"}


@pytest.mark.parametrize("block", [4, 1 << 14])
def test_radix_ranks_are_those_of_sorted(spark, monkeypatch, block):
    monkeypatch.setattr(radix_sort, "BLOCK_ROWS", block)
    rng = random.Random(3)
    rows = [(rng.choice((-5, 0, 3, 70_000)), rng.choice((rng.randrange(-(1 << 63), 1 << 63), 1, -1))) for _ in range(150)] + [(3, 1)] * 9
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    found = sorted(radix_ranks(df, ["a", "b"]).collect(), key=lambda r: r["rank"])
    assert [(r.a, r.b) for r in found] == sorted(rows) and [r["rank"] for r in found] == list(range(1, len(rows) + 1))
    assert radix_ranks(df.limit(0), ["a", "b"]).collect() == []
    same = radix_ranks(df.withColumn("a", F.lit(1).cast("long")), ["a"]).collect()
    assert sorted(r["rank"] for r in same) == list(range(1, len(rows) + 1))
