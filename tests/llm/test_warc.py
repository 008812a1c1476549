"""ARC and WARC archives: a round trip, both ARC versions, odd payloads and broken files."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from fleet_audit.llm.arc_to_warc import _is_date, arc_to_warc, read_arc, read_warc, warc_fields, write_arc
from fleet_audit.llm.op2_warc import op2_arc_to_warc

PAYLOADS = [b"", b"x", b"\n", b"\r\n\r\n", b"a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", b"y" * 99, b"z" * 100, b"z" * 100, "ü€".encode() * 60, b"end\n\n\n", bytes(range(256)) * 3]


def test_round_trip_of_any_bytes(spark, tmp_path):
    rows = [(f"http://h/{i} a", "1.2.3.4", "20010203040506", "text/html", "200", b"HTTP/1.1 200 OK\r\n\r\n", p) for i, p in enumerate(PAYLOADS)]
    df = spark.createDataFrame(rows, "url string, ip string, date string, mime string, status string, header binary, payload binary").repartition(3)
    write_arc(df, str(tmp_path / "arc"))
    back = read_arc(spark, str(tmp_path / "arc")).collect()
    assert sorted(bytes(r.payload) for r in back) == sorted(PAYLOADS)
    assert {r.version for r in back} == {1, 2} and not any(r.malformed for r in back)
    assert {r.url for r in back} == {f"http://h/{i}%20a" for i in range(len(PAYLOADS))}
    arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    warc = [r for r in read_warc(spark, str(tmp_path / "warc")).collect() if r.fields["warc-type"] != "warcinfo"]
    assert len(warc) == len(PAYLOADS) and not any(r.malformed for r in warc)
    for r in warc:
        block = bytes(r.block)
        assert r.fields["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert r.fields["warc-date"] == "2001-02-03T04:05:06Z"
    kinds = [r.fields["warc-type"] for r in warc]
    assert kinds.count("revisit") == 1
    revisit = next(r for r in warc if r.fields["warc-type"] == "revisit")
    named = next(r for r in warc if r.fields["warc-record-id"] == revisit.fields["warc-refers-to"])
    assert bytes(named.block).endswith(b"z" * 100) and named.fields["warc-payload-digest"] == revisit.fields["warc-payload-digest"]


def test_foreign_archives(spark, tmp_path):
    opening = b"1 0 crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    good = b"filedesc://a.arc 0.0.0.0 19990101000000 text/plain %d\n%s\n" % (len(opening), opening)
    body = b"two\nlines"
    record = b"http://a/ 1.1.1.1 19990102030405 text/plain %d\n%s\n" % (len(body), body)
    (tmp_path / "one.arc.gz").write_bytes(gzip.compress(good) + gzip.compress(record) + gzip.compress(record))
    (tmp_path / "cut.arc.gz").write_bytes(gzip.compress(good + record + b"http://b/ 1.1.1.1 19990102030405 text/plain 500\nshort"))
    (tmp_path / "bad.arc.gz").write_bytes(gzip.compress(good + b"http://b/ 1.1.1.1 someday text/plain 5\nshort\n" + record))
    found = read_arc(spark, str(tmp_path)).collect()
    assert sum(r.malformed for r in found) == 2
    assert [bytes(r.payload) for r in found if not r.malformed] == [body] * 3
    assert all(bytes(r.header) == b"" for r in found if not r.malformed)


def test_identifiers_and_short_dates():
    assert warc_fields("f", 1, "u", "2001")[1] == "2001-01-01T00:00:00Z"
    assert warc_fields("f", 1, "u", "20010203")[1] == "2001-02-03T00:00:00Z"
    assert warc_fields("f", 1, "u", "200102")[1] == "2001-02-01T00:00:00Z"
    assert [_is_date(d) for d in ("2001", "20011301", "20010230", "200", "2001010203", "20010102030405", "١٢٣٤")] == [True, False, False, False, True, True, False]
    assert warc_fields("f", 1, "u", "20010203")[0] != warc_fields("f", 2, "u", "20010203")[0]


def test_query_over_odd_pages(spark, tmp_path):
    same = "s" * 150
    rows = [(1, "http://a", None), (2, None, ""), (3, "u", same), (4, "u", same), (5, "v", "short"), (6, "v", "short"), (7, "http://x\ny z", "ü" * 60), (None, "n", "unknown page"), (9, "w", same)]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op2_arc_to_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert got[page].payload_bytes == len(raw) and got[page].payload_digest == hashlib.sha256(raw).hexdigest()
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type == "revisit"} == {4: ("revisit", 3), 9: ("revisit", 3)}


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op2_arc_to_warc(spark, str(tmp_path)).collect() == []


def test_pages_with_odd_urls_and_unknown_ids(spark, tmp_path):
    """A URL like that of an opening block is a page's own, and a page without an id never stands for others."""
    body = "<p>" + "x" * 200
    rows = [(1, "http://a/", "one"), (2, "filedesc://page", "two"), (3, "http://b/", body), (None, "http://c/", body), (4, "filedesc://a.arc", body), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    found = op2_arc_to_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in found) == sorted(
        [(1, "response", None, 3), (2, "response", None, 3), (3, "response", None, 203), (0, "revisit", 3, 203), (4, "revisit", 3, 203), (0, "response", None, 0)], key=lambda r: (r[0], r[1]))


def test_malformed_records_fail_a_strict_conversion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(b"filedesc://a 0.0.0.0 20000101000000 text/plain 5\n1 0 x\nhttp://a/ 1.1.1.1 20000101000000 text/html 999\nshort\n")
    assert read_arc(spark, str(tmp_path / "in")).filter("malformed").count() == 1
    arc_to_warc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="malformed record"):
        arc_to_warc(spark, str(tmp_path / "in"), str(tmp_path / "strict"), strict=True)
