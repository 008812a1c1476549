"""Legacy ARC archives to WARC, written and read as distributed text-file jobs.

Archives are gzip files that Spark's own writers and readers handle, one file to a task, so any
file system works, a lost task is repeated, and no file is ever held in memory: a file streams
through as lines, and the declared lengths say which lines belong to a record.

ARC version 1 has five fields on its header lines (URL, IP address, date, type, length), version 2
has ten (result code, checksum, location, offset and file name between type and length). The block
that opens a file says which. The converter makes of each record a WARC record of version 1.1: an
identifier derived from the file and the record's place in it, an ISO timestamp, the types, and SHA-256 digests of the
block and the payload. Of records with equal payloads of ``REVISIT_FROM`` bytes or more the first becomes a
response, the others revisits that name it and keep only their HTTP header.

A null payload is an empty one, a null URL is written as ``-``; blanks and line breaks in URLs are
percent-encoded. Rows equal in everything stay separate records. Header lines that do not parse end
the file's usable part and are reported in ``malformed``. Empty tables give no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_FROM = 100
_ARC_FIELDS = {1: 5, 2: 10}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BATCH_BYTES = 4 << 20

ARC_RECORD = "file string, place long, version int, url string, ip string, date string, mime string, status string, header binary, payload binary, malformed boolean"
WARC_RECORD = "file string, place long, fields map<string,string>, block binary, malformed boolean"


# Writing. A record and the line end that the text writer adds make up the bytes of an archive.


def _write_archive(records: DataFrame, path: str, line_end: str) -> None:
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", line_end).option("compression", "gzip").text(path)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the last item of a row is its weight in bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row[:-1])
        weight += row[-1] + 200
        if weight > _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def write_arc(records: DataFrame, path: str) -> None:
    """ARC files of ``records`` (``url, ip, date, mime, status, header, payload``), of version 1 and 2 in turn by partition.

    ``header`` is the HTTP header with its empty line, ``date`` has 14 digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2

        def rows() -> Iterator[tuple]:
            titles = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
            opening = f"{version} 0 spark".encode() + b"\n" + titles[version] + b"\n"
            first = _arc_line("filedesc://archive.arc", "0.0.0.0", "20000101000000", "text/plain", "200", opening, version) + opening
            yield first, len(first)
            for batch in batches:
                for row in batch.to_pylist():
                    block = (row["header"] or b"") + (row["payload"] or b"")
                    url = re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), row["url"] or "-") or "-"
                    record = _arc_line(url, row["ip"], row["date"], row["mime"], row["status"], block, version) + block
                    yield record, len(record)

        yield from _batches(rows(), ["record"], [pa.binary()])

    _write_archive(records.mapInArrow(run, "record binary"), path, "\n")


def _arc_line(url: str, ip: str, date: str, mime: str, status: str, block: bytes, version: int) -> bytes:
    more = ["-" if not status else status, hashlib.md5(block).hexdigest(), "-", "0", "archive.arc"] if version == 2 else []
    return (" ".join([url, ip or "0.0.0.0", date, mime or "no-type", *more, str(len(block))]) + "\n").encode("utf-8", "surrogatepass")


# Reading. Lines of a file come in order, since a gzip file is never split.


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))


class _Stream:
    """Byte counts and lines out of rows of one line each, over several files one after another."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.rows = ((f, line) for b in batches for f, line in zip(b.column("file").to_pylist(), b.column("line").to_pylist()))
        self.file: str | None = None
        self.held: tuple[str, bytes] | None = next(self.rows, None)

    def next_file(self) -> bool:
        while self.held is not None and self.held[0] == self.file:
            self.held = next(self.rows, None)
        self.file = self.held[0] if self.held else None
        return self.held is not None

    def line(self) -> bytes | None:
        """The next line of the current file without its end; None at the end of the file."""
        if self.held is None or self.held[0] != self.file:
            return None
        line = self.held[1]
        self.held = next(self.rows, None)
        return line

    def block(self, length: int) -> bytes | None:
        """The next ``length`` bytes, and the line end behind them; None if the file ends or the length is not met exactly."""
        parts, got = [], -1
        while got < length:
            line = self.line()
            if line is None:
                return None
            parts.append(line)
            got += len(line) + 1
        return b"\n".join(parts) if got == length else self._cut(parts, length)

    def _cut(self, parts: list[bytes], length: int) -> bytes | None:
        whole = b"\n".join(parts)
        if whole[length:].strip(b"\r"):
            return None
        return whole[:length]


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files (see ``ARC_RECORD``), without the block that opens each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            stream = _Stream(batches)
            while stream.next_file():
                version, place = None, 0
                while (line := stream.line()) is not None:
                    if not line.strip():
                        continue
                    found = _arc_header(line, version)
                    block = stream.block(found[-1]) if found else None
                    if block is None:
                        yield stream.file, place, version or 0, None, None, None, None, None, None, None, True, 0
                        break
                    url, ip, date, mime, status, _ = found
                    # Only a file's first record can be its opening block; a page may have such a URL, too.
                    if place == 0 and version is None and url.startswith("filedesc://"):
                        version = int(block.split(None, 1)[0]) if block[:1] in (b"1", b"2") else 1
                        continue
                    http = block.find(b"\r\n\r\n") if block[:5] == b"HTTP/" else -1
                    head, payload = (block[: http + 4], block[http + 4 :]) if http >= 0 else (b"", block)
                    yield stream.file, place, version or 1, url, ip, date, mime, status, head, payload, False, len(block)
                    place += 1

        names = [c.split()[0] for c in ARC_RECORD.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.bool_()]
        yield from _batches(rows(), names, types)

    return _lines(spark, path).mapInArrow(run, ARC_RECORD)


def _arc_header(line: bytes, version: int | None) -> tuple[str, str, str, str, str | None, int] | None:
    """URL, IP address, date, type, result code and length of a header line; None when it is not one of the version."""
    fields = line.decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
    known = _ARC_FIELDS.get(version or 0)
    if (known and len(fields) != known) or len(fields) not in _ARC_FIELDS.values() or not fields[-1].isdigit():
        return None
    if not _is_date(fields[2]):
        return None
    return *fields[:4], fields[4] if len(fields) == 10 else None, int(fields[-1])


# Conversion.


def warc_fields(file: str, place: int, url: str, date: str) -> tuple[str, str]:
    """The record identifier and the timestamp that a record of an ARC file gets."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{file}#{place}')}>", _moment(date).strftime("%Y-%m-%dT%H:%M:%SZ")


def _moment(date: str) -> datetime:
    """The moment of an ARC date of 4 to 14 digits: the parts it lacks are the first month and day and midnight."""
    month, day = date[4:6] or "01", date[6:8] or "01"
    return datetime.strptime(date[:4] + month + day + date[8:].ljust(6, "0"), "%Y%m%d%H%M%S")


def _is_date(date: str) -> bool:
    try:
        return re.fullmatch(r"\d{4,14}", date, re.ASCII) is not None and _moment(date) is not None
    except ValueError:
        return False


def usable(records: DataFrame, strict: bool) -> Column:
    """Keeps the records that could be read. With ``strict`` one that could not fails the job and names its file."""
    if not strict:
        return ~F.col("malformed")
    where = F.concat(F.lit("malformed record "), F.col("place").cast("string"), F.lit(" in "), F.col("file"))
    return F.when(F.col("malformed"), F.raise_error(where).cast("boolean")).otherwise(True)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, order: Column | None = None, strict: bool = False) -> None:
    """Convert all ARC files below ``arc_path``. ``order`` over ``header, date, file, place`` says which of equal payloads is first.

    What cannot be read is left out and stays visible in ``read_arc``; with ``strict`` it fails the conversion.
    """
    arc = read_arc(spark, arc_path)
    arc = arc.filter(usable(arc, strict))
    rank = F.struct(*([order] if order is not None else []), "date", "file", "place")
    sums = arc.select("file", "place", "url", "date", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("bytes"), rank.alias("rank"))
    shared = sums.filter(F.col("bytes") >= REVISIT_FROM).groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = sums.filter(F.col("bytes") >= REVISIT_FROM).join(shared, "digest").filter("rank != first").select(
        F.col("file").alias("f"), F.col("place").alias("p"), F.col("first.file").alias("to_file"), F.col("first.place").alias("to_place"))
    marked = arc.join(revisits, (F.col("file") == F.col("f")) & (F.col("place") == F.col("p")), "left").drop("f", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            info = b"software: arc-to-warc\r\nformat: WARC File Format 1.1\r\n"
            opening = _warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2000-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info)
            started = False
            for batch in batches:
                for r in batch.to_pylist():
                    if not started:
                        yield opening, len(opening)
                        started = True
                    record = _converted(r)
                    yield record, len(record)

        yield from _batches(rows(), ["record"], [pa.binary()])

    _write_archive(marked.mapInArrow(run, "record binary"), warc_path, "\r\n")


def _converted(r: dict) -> bytes:
    identifier, moment = warc_fields(r["file"], r["place"], r["url"], r["date"])
    revisit = r["to_file"] is not None
    block = r["header"] + (b"" if revisit else r["payload"])
    http = bool(r["header"])
    fields = {
        "WARC-Type": "revisit" if revisit else "response" if http else "resource",
        "WARC-Record-ID": identifier, "WARC-Date": moment, "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"],
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(r['payload']).hexdigest()}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response" if http else r["mime"],
    }
    if revisit:
        fields |= {"WARC-Profile": _REVISIT_PROFILE, "WARC-Refers-To": warc_fields(r["to_file"], r["to_place"], "", r["date"])[0]}
    return _warc_record(fields, block)


def _warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record up to the first of the two line ends that close it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (see ``WARC_RECORD``); field names are in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            stream = _Stream(batches)
            while stream.next_file():
                place = 0
                while (line := stream.line()) is not None:
                    if not line.strip():
                        continue
                    fields: dict[str, str] = {}
                    known = line.startswith(b"WARC/")
                    while known and (line := stream.line()) is not None and line.strip(b"\r"):
                        name, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r").partition(":")
                        fields[name.strip().lower()] = value.strip()
                    length = fields.get("content-length", "")
                    block = stream.block(int(length)) if known and length.isdigit() else None
                    if block is None:
                        yield stream.file, place, list(fields.items()), None, True, 0
                        break
                    yield stream.file, place, list(fields.items()), block, False, len(block)
                    place += 1

        yield from _batches(rows(), ["file", "place", "fields", "block", "malformed"], [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()])

    return _lines(spark, path).mapInArrow(run, WARC_RECORD)
