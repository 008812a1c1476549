"""The registered query of :mod:`fleet_audit.llm.arc_to_warc`: pages to ARC, ARC to WARC, and the WARC files read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_audit.llm.arc_to_warc import arc_to_warc, read_warc, usable, write_arc
from fleet_audit.llm.shared import kept, new_path, table

#: The HTTP header line that carries a page's id through the archives.
_PAGE = "X-Page-Id: "


def _page_id(header):
    return F.nullif(F.regexp_extract(header.cast("string"), _PAGE + r"(-?[0-9]+)\r\n", 1), F.lit("")).cast("long")


def _body(block: str):
    """What follows the HTTP header, which is ASCII, so that characters and bytes count alike up to its end."""
    end = F.locate("\r\n\r\n", F.col(block).cast("string"))
    return F.substr(F.col(block), end + 4)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"), F.coalesce(F.concat(F.lit(_PAGE), F.col("page_id"), F.lit("\r\n")), F.lit("")), F.lit("\r\n"))
    crawled = F.coalesce(F.pmod("page_id", F.lit(86_400 * 365)), F.lit(0)) + 946_684_800
    records = pages.select(
        "url", F.lit("192.0.2.1").alias("ip"), F.date_format(F.timestamp_seconds(crawled), "yyyyMMddHHmmss").alias("date"), F.lit("text/html").alias("mime"),
        F.lit("200").alias("status"), header.cast("binary").alias("header"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(records, arc)
    known = _page_id(F.col("header"))
    arc_to_warc(spark, arc, warc, order=F.struct(known.isNull().alias("unknown"), known.alias("page_id")), strict=True)

    found = read_warc(spark, warc)
    found = found.filter(usable(found, strict=True)).filter("fields['warc-type'] != 'warcinfo'")
    split = found.select(
        F.col("fields")["warc-record-id"].alias("record"), F.col("fields")["warc-type"].alias("record_type"), F.col("fields")["warc-refers-to"].alias("to"),
        F.col("fields")["warc-payload-digest"].alias("declared"), _page_id(F.substring("block", 1, 1000)).alias("page_id"), _body("block").alias("payload"))
    back = kept(split.select(
        "record", "record_type", "to", "page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("own_digest"), "declared"), "records")
    responses = back.filter("record_type = 'response'").select(
        F.col("record").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("own_digest").alias("full_digest"))
    named = back.filter("to is not null").select("to", "page_id").join(responses, "to").select("page_id", "refers_to", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"))
    plain = back.filter("to is null").select("page_id", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", F.col("own_digest").alias("payload_digest"), "record_type")
    return plain.unionByName(named)


op2_sql = """
with sized as (select page_id, coalesce(html, '') body, strlen(coalesce(html, '')) n from pages),
ranked as (select *, row_number() over (partition by body order by page_id nulls last) k, min(page_id) over (partition by body) first from sized)
select page_id, n::bigint payload_bytes, sha256(body) payload_digest,
    case when n >= 100 and k > 1 then 'revisit' else 'response' end record_type,
    case when n >= 100 and k > 1 then first end refers_to
from ranked
"""
