"""SimHash classes against all pairs of fingerprints, and verified classes against all pairs of texts."""

import random

import xxhash
from pyspark.sql import functions as F

from fleet_audit.llm import hamming, near_duplicates
from fleet_audit.llm.hamming import ball_masks, hamming_links, segment_plan
from fleet_audit.llm.near_duplicates import drop_near_duplicates, near_duplicate_classes
from fleet_audit.llm.op8_simhash import op8_simhash_near_dedup
from fleet_audit.llm.shared import row_ids
from fleet_audit.llm.simhash import fingerprint
from tests.llm.test_components import union_find

MASK = (1 << 64) - 1


def slow_print(text, words):
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys((0x20, 9, 10, 11, 12, 13), " ")).split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["The", "cat", "ÄB", "x\ty", "\x0bz", "a b"], k=rng.randrange(12))) for _ in range(200)] + [None, "", "one", " \n "]
    assert [fingerprint(t, 4) & MASK for t in texts] == [slow_print(t, 4) for t in texts]


def test_segments_guarantee_the_radius():
    rng = random.Random(2)
    for radius, segments in ((4, 3), (4, 2), (5, 3), (3, 4), (8, 4), (0, 3)):
        plan = segment_plan(radius, segments)
        for _ in range(300):
            mask = sum(1 << b for b in rng.sample(range(64), radius))
            assert any((mask >> s & ((1 << w) - 1)) in ball_masks(w, ball) for s, w, ball in plan)


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        for _ in range(rng.randrange(1, 25)):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = union_find([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & MASK).bit_count() <= 4])
    for segments in (2, 3):
        links = [(r.a, r.b) for r in hamming_links(spark.createDataFrame([(p, 1) for p in signed], "print long, n long"), 4, segments).collect()]
        assert all(((a ^ b) & MASK).bit_count() <= 4 for a, b in links)
        assert union_find(links) == want


def test_a_dense_group_is_not_expanded_into_pairs(spark):
    rng = random.Random(4)
    prints = {sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 3))) for _ in range(1500)}
    links = hamming_links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 1 + 9 * (p == 0)) for p in prints], "print long, n long"), 4)
    assert links.count() < 60 * len(prints) < len(prints) ** 2 / 8


def test_look_ups_are_not_broadcast(spark):
    prints = spark.range(60_000).select(F.xxhash64("id").alias("print"), F.lit(1).cast("long").alias("n"))
    plan = hamming_links(prints, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_broadcast_and_merged_links_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    prints = {sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 3))) for _ in range(300)}
    frame = spark.createDataFrame([(p, 1) for p in prints], "print long, n long")
    few = {(r.a, r.b) for r in hamming_links(frame, 4).collect()}
    monkeypatch.setattr(hamming, "BROADCAST_PRINTS", 10)
    assert few == {(r.a, r.b) for r in hamming_links(frame, 4).collect()} and few


def test_query_with_odd_rows(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base), (4, base), (7, base.replace("w5 ", "v5 ")), (1, "other words entirely here"), (2, None), (3, ""), (8, " \n"), (None, base), (4, base), (6, "A b"), (5, "a B")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, print string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_simhash_near_dedup(spark, str(tmp_path)).collect()
    prints = {slow_print(t, 4) for _, t in rows}
    roots = union_find([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in rows:
        root = roots.get(slow_print(t, 4), slow_print(t, 4))
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted((i is None, i, f"{slow_print(t, 4):016x}", least[roots.get(slow_print(t, 4), slow_print(t, 4))]) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_verified_classes(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randrange(60, 200))
        texts.append(base)
        for _ in range(4):
            near = list(base)
            for k in rng.sample(range(len(near)), rng.randrange(0, 4)):
                near[k] = "edit" + str(rng.random())
            texts.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "one"), (503, "one"), (504, "two")]

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    links = []
    for i, t in rows:
        for j, u in rows:
            a, b = shingles(t), shingles(u)
            close = (slow_print(t, 4) ^ slow_print(u, 4)).bit_count() <= 4
            if i < j and (close or len(a & b) >= 0.8 * len(a | b) > 0):
                links.append((i, j))
    roots = union_find(links)
    docs = row_ids(spark.createDataFrame(rows, "doc_id long, text string"), "test", "_row")
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs).collect()}
    assert got == {i: roots.get(i, i) for i, _ in rows}
    left = drop_near_duplicates(spark.createDataFrame([(*r, "x", 5, 6) for r in rows] + [(0, rows[0][1], "x", 5, 6)], "doc_id long, text string, class_id string, _row int, `row` int"))
    assert left.columns == ["doc_id", "text", "class_id", "_row", "row"]
    assert sorted((r.doc_id, r["_row"], r["row"]) for r in left.collect()) == sorted((i, 5, 6) for i in set(got.values()))


def block_edits():
    """Texts of 200 and 600 words, each with one block appended, cut off or put in, at similarities from 0.8 to 0.95."""
    rng, pairs = random.Random(7), []
    for n in (200, 600):
        for like in (0.805, 0.84, 0.87, 0.91, 0.95):
            for kind in ("append", "cut", "insert"):
                for _ in range(4):
                    base = [f"w{rng.getrandbits(40)}" for _ in range(n)]
                    # What is put in breaks four shingles and adds four.
                    longer = int((n - 8) / like - n) if kind == "insert" else int((n - 4) * (1 / like - 1))
                    block = [f"x{rng.getrandbits(40)}" for _ in range(longer)]
                    at = rng.randrange(10, n - 10)
                    near = {"append": base + block, "cut": base[: n - int((n - 4) * (1 - like))], "insert": base[:at] + block + base[at:]}[kind]
                    pairs.append((" ".join(base), " ".join(near)))
    return pairs


def test_one_block_changed(spark):
    pairs = block_edits()
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    docs = row_ids(spark.createDataFrame(rows, "doc_id long, text string"), "test", "_row")
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs).collect()}
    assert [i for i in range(len(pairs)) if got[2 * i] != got[2 * i + 1]] == []
    assert len(set(got.values())) == len(pairs)


def test_unknown_and_repeated_ids_name_no_class(spark):
    rows = [(None, "one text without any id"), (None, "a second and wholly different text"), (7, "words of the first"), (7, "other things the second says"), (7, "words of the first")]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted({(i or 0, t) for i, t in rows})


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_near_duplicates(empty).collect() == []


def test_a_family_gives_few_pairs_and_keeps_its_links(spark, monkeypatch):
    """Texts that share most of a passage but are not alike, some of them with a near copy."""
    rng = random.Random(8)
    passage = [f"w{rng.getrandbits(30)}" for _ in range(160)]
    texts = []
    for k in range(300):
        own = list(passage)
        for at in rng.sample(range(len(own)), 14):
            own[at] = f"x{rng.getrandbits(30)}"
        texts.append(own)
    for k in range(0, 300, 6):
        texts.append([*texts[k][:-1], f"y{k}"])
    pairs = []
    seen = near_duplicates.similar_pairs

    def counted(found, *rest):
        pairs.append(found.count())
        return seen(found, *rest)

    monkeypatch.setattr(near_duplicates, "similar_pairs", counted)
    docs = row_ids(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "test", "_row")
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs).collect()}
    assert sum(got[300 + n] == got[6 * n] for n in range(50)) >= 49
    assert sum(pairs) < 40 * len(texts) < len(texts) ** 2 / 8
