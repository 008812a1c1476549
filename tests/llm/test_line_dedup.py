"""Line chunks: what repeats is cut once, wherever it stands, and nothing else changes."""

import random

import pytest
from pyspark.sql import functions as F

from fleet_audit.llm import line_dedup
from fleet_audit.llm.line_dedup import dedup_lines, split_lines

PASSAGE = "\n".join(f"passage line {i} with some more words to it" for i in range(12))


def lines(n, tag):
    return "\n".join(f"{tag} own line number {i} and a few words" for i in range(n))


def run(spark, rows, schema="doc_id long, text string"):
    return {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, schema)).collect()}


def test_a_shifted_passage_stays_once(spark):
    rows = [(2, lines(5, "b") + "\n" + PASSAGE + "\n" + lines(3, "c")), (1, lines(2, "a") + "\n" + PASSAGE + "\n"), (3, "intro " + PASSAGE + " outro"), (4, lines(9, "d"))]
    got = run(spark, rows)
    assert got[1].text == rows[1][1] and got[4].text == rows[3][1]
    assert got[2].removed_lines >= 8 and lines(5, "b") in got[2].text and lines(3, "c") in got[2].text
    assert PASSAGE not in got[2].text and got[3].removed_lines >= 6


def test_a_copy_goes_and_prose_counts_as_lines(spark):
    prose = " ".join(f"Sentence number {i} of a single paragraph here." for i in range(20))
    got = run(spark, [(1, prose), (2, prose), (3, prose + " More.")])
    assert got[1].text == prose and got[2].text == "" and len(got[3].text) < 80


def test_repeats_inside_a_text_and_short_chunks(spark):
    got = run(spark, [(1, PASSAGE + "\n" + PASSAGE), (2, "Yes.\nNo.\nunique one here"), (3, "Yes.\nNo.\nunique two here")])
    assert got[1].text.startswith(PASSAGE) and got[1].text.count(PASSAGE) == 1 and got[1].removed_lines >= 6
    assert got[2].removed_lines == 0 and got[3].removed_lines == 0


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, PASSAGE, "c"), (None, PASSAGE, "c"), (3, PASSAGE, "d"), (3, PASSAGE, "d"), (4, "a\x01b. c\n\x01", "e"), (5, "x" * 200_000, "f")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, start string")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.start) for r in got) == sorted(
        (i or 0, "" if i is None else t or "", x) for i, t, x in rows)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_put_together_are_the_text(spark):
    long = " ".join(f"word{i * i}" for i in range(90))
    texts = ["a. b\nc", "\n\n", "a.b", ". . ", "x\x01. y\x01\n", "end. ", long, "\t " + long + "\n" + long + "\x01", "汉字" * 200, "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", split_lines(F.col("text")).alias("l"))
    assert all("".join(r.l) == r.text for r in df.collect())
    lines = {r.text: r.l for r in df.collect()}
    assert len(lines[long]) > 5 and len(lines["汉字" * 200]) in (1, 200, 201, 400) and len(lines["x" * 5000]) == 1


def _words(draw, n, tag):
    return " ".join(f"{tag}{draw.randrange(10**9)}" for _ in range(n))


@pytest.mark.parametrize("m", range(1, 7))
def test_passages_of_few_lines_go_whole(spark, m):
    """A passage of ``m`` whole lines between lines of their own, in two texts: what a comparison of all runs of lines finds is cut."""
    draw, rows, passages = random.Random(m), [], []
    for k in range(60):
        passage = "\n".join(_words(draw, 80 if m == 1 else 14, "p") for _ in range(m))
        passages.append(passage)
        for side in (0, 1):
            own = ["\n".join(_words(draw, 12, "own") for _ in range(draw.randrange(1, 4))) for _ in range(2)]
            rows.append((2 * k + side, f"{own[0]}\n{passage}\n{own[1]}"))
    got = run(spark, rows)
    shares = []
    for k, passage in enumerate(passages):
        before, after = rows[2 * k + 1][1].split(passage)
        left = got[2 * k + 1].text
        assert got[2 * k].text == rows[2 * k][1]
        assert left.startswith(before) and left.endswith(after.lstrip("\n"))
        shares.append(1 - max(0, len(left) - len(before) - len(after)) / len(passage))
    assert sum(shares) / len(shares) >= 0.9 and min(shares) >= 0


@pytest.mark.parametrize("n, least", [(60, 0.7), (120, 0.85)])
def test_a_passage_inside_a_longer_line(spark, n, least):
    """Words at its ends stay, up to the first and from the last cut inside it; its surroundings stay whole."""
    draw, rows = random.Random(n), []
    for k in range(40):
        passage = _words(draw, n, "p")
        rows += [(2 * k + side, f"{_words(draw, 30, 'own')} {passage} {_words(draw, 30, 'own')}") for side in (0, 1)]
    got = run(spark, rows)
    assert all(got[i].text == text for i, text in rows if i % 2 == 0)
    assert all(got[i].text.count("own") == 60 for i, _ in rows)
    left = sum(got[i].text.count("p") for i, _ in rows if i % 2)
    assert left <= (1 - least) * 40 * n


def test_blank_lines_and_scripts_without_blanks(spark):
    letters = [chr(0x4E00 + 7 * i) for i in range(1200)]
    chinese = "".join(letters[:300])
    got = run(spark, [(1, "start\n" + chinese), (2, "another\n" + chinese), (3, "Only one repeated line of more than eight words here\n\nrest a"), (4, "Only one repeated line of more than eight words here\n\nrest b")])
    assert got[1].text == "start\n" + chinese and len(got[2].text) < 60
    assert got[3].removed_lines == got[4].removed_lines == 0


def _plain(rows):
    """What is left by comparing the chunks of all texts, taken line by line, as strings."""
    parts = {r: None for r in rows}
    seen, kept_lines = {}, {}
    for i, lines in sorted(parts):
        bare = [x.rstrip(" \n\r\t") for x in lines]
        gone = set()
        for a in range(len(lines)):
            if not bare[a]:
                continue
            words = 0
            for n in range(1, 17):
                if a + n > len(lines):
                    break
                words += len(bare[a + n - 1].split())
                if n > 1 and bare[a + n - 1] and words >= 8:
                    if tuple(bare[a:a + n]) in seen:
                        gone |= set(range(a, a + n))
                    seen.setdefault(tuple(bare[a:a + n]), (i, a))
                    break
        kept_lines[i] = "".join(x for k, x in enumerate(lines) if k not in gone)
    return kept_lines


@pytest.mark.parametrize("weak", [False, True])
def test_equal_to_plain_comparison(spark, monkeypatch, weak):
    """With every chunk a boundary; with a weak hash of lines too, where different lines share a hash."""
    monkeypatch.setattr(line_dedup, "BOUNDARIES", 2**40)
    if weak:
        monkeypatch.setattr(line_dedup, "_line_hash", lambda bare: F.xxhash64(F.length(bare) % 3))
    draw = random.Random(5)
    pool = [f"{'w ' * draw.randrange(1, 7)}{draw.randrange(40)}\n" for _ in range(25)] + ["\n"]
    rows = [(i, tuple(draw.choice(pool) for _ in range(draw.randrange(1, 9)))) for i in range(120)]
    got = run(spark, [(i, "".join(lines)) for i, lines in rows])
    assert {i: r.text for i, r in got.items()} == _plain(rows)


def test_clashing_names(spark):
    rows = [(1, PASSAGE, "a", "b", 3, 9), (2, PASSAGE, "c", "d", 4, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string, digest string, hash int, removed_lines int")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[2].text == "" and got[2]._digest == "c" and got[2].digest == "d" and got[2].hash == 4 and got[1].removed_lines == 0
    taken = df.withColumnsRenamed({"_digest": "cut_id", "digest": "Cut_Digest", "hash": "cut_lines"})
    assert {r.doc_id: (r.cut_id, r.Cut_Digest, r.cut_lines) for r in dedup_lines(taken).collect()} == {1: ("a", "b", 3), 2: ("c", "d", 4)}
