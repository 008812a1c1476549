"""Benchmark passages against a search over every window."""

import collections
import random
import re

from fleet_audit.llm.decontaminate import decontaminate, find_contamination


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(w):
    return collections.Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def best(doc, item):
    d, i = words(doc), words(item)
    if not d or not i:
        return 0.0
    theirs, top = shingles(i), 0.0
    for k in range(max(1, len(d) - len(i) + 1)):
        mine = shingles(d[k : k + len(i)])
        common = sum((mine & theirs).values())
        top = max(top, common / (sum(mine.values()) + sum(theirs.values()) - common))
    return top


def test_windows_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(20, 90)))) for k in range(12)] + [(50, "three short words"), (51, None), (52, ""), (53, "..."), (54, "the the the the the the the the")]
    docs = []
    for k in range(60):
        before, after = (" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(2))
        passage = words(items[k % 12][1])
        for _ in range(rng.randrange(0, 3)):
            passage[rng.randrange(len(passage))] = "edit"
        docs.append((k, f"{before} {', '.join(passage).upper()}. {after}"))
    docs += [(100, None), (101, ""), (102, "nothing of it at all"), (103, "Three short, words!"), (104, "the " * 300), (None, items[0][1]), (0, docs[0][1])]
    found = find_contamination(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = {(d, i): s for d, t in docs for i, u in items if (s := best(t, u)) >= 0.8}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_documents_dropped(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b c " + item + " d", "x"), (2, "clean text", "y"), (None, item, "z"), (2, None, "y")], "doc_id long, text string, lang string")
    left = decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, item), (2, ""), (2, "clean text")]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == 4
    assert decontaminate(docs.limit(0), none).count() == 0
