"""Base spans against the contract's own patterns, disclosing terms against counts in plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from fleet_audit.llm import disclosure
from fleet_audit.llm.disclosure import base_spans, find_disclosures, sanitise, spans_text
from fleet_audit.llm.op4_disclosure import op4_pii_disclosure

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_base_spans(spark):
    rng = random.Random(3)
    texts = [
        "a@b.c%x@d.e", "é\U0001F600 x@y.zz +12 (345) 678-90123", "+1" + " " * 50_000 + "2", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004", "4111 1111 1111 1111",
        "4111111111111111 0", "", None, "a.b@c.d@e.f.g@h", "x@@y.z", "%@a.b.", "1.1.1.1@a.b", "12" * 400,
    ] + ["".join(rng.choices("a1@.+- ()%45\n", k=60)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", spans_text(base_spans(F.coalesce("text", F.lit("")))).alias("s"))
    assert [(texts[r.id], r.s) for r in df.collect() if r.s != plain(texts[r.id])] == []


def test_long_runs_take_no_quadratic_time(spark):
    texts = ["1" * 200_000, "a" * 200_000, "1." * 100_000, "+" * 100_000, "a@" * 50_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.size(base_spans(F.col("text"))).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 25_000, 0, 0]


def test_terms_that_give_an_entity_away(spark):
    docs = [(1, "write to zorblax at a@b.com today"), (2, "zorblax says a@b.com works"), (3, "today is fine"), (4, "fine words only today")] + [(10 + k, f"plain words today {k}") for k in range(20)]
    docs += [(60, "copy unique99 c@d.com"), (61, "copy unique99 c@d.com")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.id: [s.asDict() for s in r.spans] for r in find_disclosures(df).collect()}
    terms = {(i, s["value"]) for i, found in spans.items() for s in found if s["kind"] == 4}
    assert terms == {(1, "zorblax"), (2, "zorblax")}  # one text is no evidence, however often copied
    n, both, held, term = len(docs), 2, 2, 2
    share = math.log(both * n / (held * term)) / math.log(n / held)
    assert all(abs(s["revealed"] - share) < 1e-9 for s in spans[1] if s["kind"] == 4)
    out = {r.doc_id: r.sanitised for r in sanitise(df).collect()}
    assert out[1] == "write to  at [email] today" and out[3] == "today is fine" and len(out) == len(docs)


def test_a_unique_entity_and_a_term_far_from_it(spark):
    far = "common words stand here " * 20
    docs = [(1, f"{far}zorblax {far}a@b.com or 10.0.0.1 and 256.1.1.1 {far}"), (2, "zorblax is elsewhere"), (3, f"\U0001F600 single {far}")]
    docs += [(10 + k, f"{far}{k}") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.id: [s.asDict() for s in r.spans if s["kind"] == 4] for r in find_disclosures(df).collect()}
    share = math.log(len(docs) / 2) / math.log(len(docs))
    assert [(s["start"], s["end"], s["value"], round(s["revealed"], 9)) for s in spans.pop(1)] == [(len(far), len(far) + 7, "zorblax", round(share, 9))]
    assert not any(spans.values())  # neither a common word nor a text without an entity
    assert "zorblax" not in sanitise(df).filter("doc_id = 1").first().sanitised


def test_generalised_terms(spark, monkeypatch):
    monkeypatch.setattr(disclosure, "THRESHOLD", 0.5)
    docs = [(1, "zorblax at a@b.com"), (2, "zorblax with a@b.com"), (3, "zorblax alone")] + [(10 + k, f"plain {k}") for k in range(20)]
    out = {r.doc_id: r.sanitised for r in sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1] == "[term] at [email]" and out[3] == "zorblax alone"


def test_query_with_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a@b.com"), (3, "x 10.0.0.1"), (3, "x 10.0.0.1"), (4, "y" * 100_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_pii_disclosure(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in got) == sorted((i or 0, int(i is None), int(i == 3), plain(t)) for i, t in rows)
    assert find_disclosures(spark.createDataFrame([], "doc_id long, text string")).collect() == []
