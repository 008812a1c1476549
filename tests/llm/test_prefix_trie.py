"""The prefix trie against one built in plain Python, and its edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fleet_audit.llm import prefix_trie as trie
from fleet_audit.llm.op12_prefix_trie import rebuilt
from fleet_audit.llm.shared import kept

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string"


def digest(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def slow_trie(rows):
    turns = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            turns[r[0]].append(r)
    for c in turns:
        turns[c].sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        turns[c] = [(r[2] or "", r[3] or "") for r in turns[c]]
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        sequence = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append((c, d == len(sequence)))
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(found) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c, end in found if end)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in found), len(node), parent, len(found), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def fast_trie(df):
    turns, convs = trie.numbered_turns(df)
    found = trie.prefix_trie(kept(rebuilt(turns, convs), "rebuilt"), convs)
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=lambda r: (r[1], r[0]))


def conversations(seed):
    rng = random.Random(seed)
    shared = [(rng.choice(("user", "bot")), f"turn {k} é" * rng.randrange(3)) for k in range(30)]
    rows = []
    for c in [*rng.sample(range(420), 60), 0, 100, -7, -100]:
        length, keep = rng.choice((1, 2, 5, 8, 9, 16, 17, 25)), rng.choice((0, 3, 7, 8, 9, 16, 30))
        for t in range(length):
            role, text = shared[t] if t < keep else (rng.choice(("user", None)), rng.choice((None, "", "x", "long text")))
            rows.append((c, t, role, text))
    return rows


@pytest.mark.parametrize("block, piece, bits", [(8, 1 << 12, 12), (3, 2, 1), (1, 3, 4)])
def test_nodes_are_those_of_a_plain_trie(spark, monkeypatch, block, piece, bits):
    for name, value in (("BLOCK_TURNS", block), ("PIECE_ROWS", piece), ("_ID_BITS", bits)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(block)
    assert fast_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)) == slow_trie(rows)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "lost"), (2, None, "user", "b"), (300, 5, "a", "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, node string")
    assert fast_trie(df) == slow_trie(rows)


def test_empty_and_turnless(spark):
    assert fast_trie(spark.createDataFrame([], SCHEMA)) == []
    c = next(c for c in range(500, 600) if zlib.crc32(str(c).encode()) % 6 >= 1 and c % 100)
    rows = [(c, 0, "user", "alone")]
    assert fast_trie(spark.createDataFrame(rows, SCHEMA)) == slow_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
