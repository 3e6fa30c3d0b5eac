"""Legacy ARC archives to WARC, with one stored copy of equal payloads.

An ARC file begins with a version block that names the fields of the header lines to come (5 in version 1, 10 in version
2); each record is a header line, the declared number of bytes, and a line feed. The converter reads records by those
lengths and makes the WARC fields that ARC lacks: record ids (named UUIDs of target, time, key and digest, so a repeated
run writes the same), ISO times, record types and SHA-1 digests. Of records with equal payloads of at least
``LEAST_BYTES`` that with the largest key keeps its payload; the others become revisits.

Files are written by Spark's text writer: a WARC record ends in two line breaks and an ARC record in one, so the records are
the lines and those ends are the line separator. They work on any store Spark writes to, and a task that is run again
replaces its file. Each file holds one task's rows; the reader takes a file at a time and streams through its records.

Cases: null bodies are empty; null keys are left out of the record and read back as null, and are never the one kept if
the group has a key; rows that share the kept key are all responses; blanks in a target are percent-encoded, a null target is
``urn:none``; files without a version block are read by the number of fields; empty tables give empty results.

Damaged files: a line that is no header of the file's version, and a block that the file's end cuts short, give a row that names
the problem, with the offset in the (unpacked) file. Reading goes on at the next line that parses as a header, so no later record is
lost; after a header whose length does not end at a line break it goes on at the next header inside its block, if there
is one. :func:`convert` writes the records and gives the problems out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickerloom.llm.work import discard, stage
from tickerloom.session import work_path

LEAST_BYTES = 1000
# Header fields of the two versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"
#: Extension fields: what a revisit's reader needs without looking up the record it refers to.
LENGTH_FIELD, REFERS_KEY_FIELD = "WARC-X-Payload-Length", "WARC-X-Refers-To-Key"
_CRLF, _END = "\r\n", "\r\n\r\n"
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
ARC_ROWS = ("key string, url string, ip string, date string, mime string, version int, http binary, payload binary, "
            "digest string, record_id string, problem string, problem_at bigint")
WARC_ROWS = ("key string, record_type string, record_id string, url string, date string, payload_bytes bigint, "
             "payload_digest string, refers_to string, payload binary, digest_ok boolean, problem string, problem_at bigint")


def _first_of_file() -> Column:
    """True for the first row of each task, and so of each file."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0


def write_arc(rows: DataFrame, path: str, key: str, url: str, body: str, date: str = "20240101000000",
              version: int = 1) -> None:
    """Writes gzip ARC files: an HTTP response with ``body`` for each row. ``date`` has 14 digits."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 corpus\n{' '.join(fields)}\n"
    rest = " 200 - - 0 -" if version == 2 else ""
    head = f"filedesc://corpus.arc 0.0.0.0 {date} text/plain{rest} {len(about)}\n{about}\n"
    target = F.coalesce(F.col(url), F.lit("urn:none"))
    for blank, code in ((" ", "%20"), ("\n", "%0A"), ("\r", "%0D"), ("\t", "%09")):
        target = F.replace(target, F.lit(blank), F.lit(code))
    named = F.when(F.col(key).isNotNull(), F.concat(F.lit(f"{KEY_HEADER}: "), F.col(key).cast("string"), F.lit(_CRLF)))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"),
                     F.coalesce(named, F.lit("")), F.lit(_CRLF), F.coalesce(F.col(body), F.lit("")))
    built = rows.select(target.alias("target"), block.alias("block"))
    line = F.concat_ws(" ", "target", F.lit(f"0.0.0.0 {date} text/html{rest}"), F.octet_length("block").cast("string"))
    value = F.concat(F.when(_first_of_file(), F.lit(head)).otherwise(""), line, F.lit("\n"), F.col("block"))
    built.select(value.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Unpacked:
    """The bytes of a plain or gzip file, of which some can be given back to be read again."""

    def __init__(self, content: bytes):
        raw = io.BytesIO(content)
        self.file = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
        self.held, self.at, self.before = b"", 0, 0
        self.damage: str | None = None

    def _more(self) -> bool:
        try:
            part = b"" if self.damage else self.file.read1(1 << 20)
        except (EOFError, OSError, zlib.error) as error:
            part, self.damage = b"", str(error)
        if part:
            self.before += self.at
            self.held, self.at = self.held[self.at :] + part, 0
        return bool(part)

    def tell(self) -> int:
        return self.before + self.at

    def read(self, size: int) -> bytes:
        while len(self.held) - self.at < size and self._more():
            pass
        out = self.held[self.at : self.at + size]
        self.at += len(out)
        return out

    def readline(self) -> bytes:
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                return self.read(seen)
        return self.read(end + 1 - self.at)

    def unread(self, data: bytes) -> None:
        """Gives back what was read last."""
        if self.at >= len(data):
            self.at -= len(data)
        else:
            self.before += self.at - len(data)
            self.held, self.at = data + self.held[self.at :], 0


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, end, payload = block.partition(b"\r\n\r\n")
    return (head + end, payload) if end else (b"", block)


def _http_field(http: bytes, name: str) -> str | None:
    for line in http.split(b"\r\n"):
        field, colon, value = line.partition(b":")
        if colon and field.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


@dataclass(frozen=True)
class Header:
    """A header line of an ARC record."""

    values: dict[str, str]
    size: int

    @staticmethod
    def of(line: bytes, fields: list[str], sure: bool = True) -> Header | None:
        """None if the line does not fit the fields. Where it is not sure that a header stands here, the target must have a scheme."""
        values = dict(zip(fields, line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1), strict=False))
        size = values.get("Archive-length", "")
        fits = len(values) == len(fields) and size.isdigit() and values["Archive-date"].isdigit()
        fits = fits and (sure or _SCHEME.match(values["URL"]) is not None)
        return Header(values, int(size)) if fits else None


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of an ARC file by their declared lengths, and its problems; the version block sets the fields and is left out."""
    stream, version, fields, lost = _Unpacked(content), None, None, False
    while line := stream.readline():
        if not line.strip():
            continue
        at = stream.tell() - len(line)
        if fields is None and line.startswith(b"filedesc://"):
            version, fields = _version_block(stream, line)
            continue
        if fields is None:
            version = 2 if len(line.split(b" ")) >= len(ARC_FIELDS[2]) else 1
            fields = ARC_FIELDS[version]
        header = Header.of(line, fields, sure=not lost)
        if header is None:
            if not lost:  # one row for each damaged place, however many lines it has
                yield {"problem": f"no header of version {version}: {line[:200]!r}", "problem_at": at}
            lost = True
            continue
        lost = False
        block = stream.read(header.size)
        after = stream.readline()
        stream.unread(after)
        if len(block) < header.size or (after.strip() and not Header.of(after, fields, sure=False)):
            said = f"{len(block)} of {header.size} bytes" if len(block) < header.size else "a block that ends inside a line"
            yield {"problem": f"{said}: {line[:200]!r}", "problem_at": at}
            # The length is wrong: the next record begins inside of what it covers, or after it.
            lost = True
            stream.unread(block[_next_header(block, fields) :])
            continue
        http, payload = _split_http(block)
        key, digest = _http_field(http, KEY_HEADER), hashlib.sha1(payload).hexdigest()
        values = header.values
        named = f"{values['URL']} {values['Archive-date']} {key} {digest}"
        yield {"key": key, "url": values["URL"], "ip": values["IP-address"], "date": values["Archive-date"],
               "mime": values["Content-type"], "version": version, "http": http, "payload": payload, "digest": digest,
               "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, named)}>", "problem": None}
    if stream.damage:
        yield {"problem": f"damaged file: {stream.damage}", "problem_at": stream.tell()}


def _version_block(stream: _Unpacked, line: bytes) -> tuple[int, list[str]]:
    """The version and the names of the fields that its block gives."""
    size = line.rstrip().rsplit(b" ", 1)[-1]
    lines = stream.read(int(size)).decode("utf-8", "replace").split("\n") if size.isdigit() else [""]
    version = int(lines[0].split(" ")[0]) if lines[0][:2] in ("1 ", "2 ") else 1
    named = lines[1].split(" ") if len(lines) > 1 else []
    return version, named if set(ARC_FIELDS[1]) <= set(named) else ARC_FIELDS[version]


def _next_header(block: bytes, fields: list[str]) -> int:
    """Where in a block a line begins that parses as a header, or the block's length."""
    at = block.find(b"\n")
    while at >= 0:
        end = block.find(b"\n", at + 1)
        if Header.of(block[at + 1 : end if end >= 0 else len(block)], fields, sure=False):
            return at + 1
        at = end
    return len(block)


def warc_records(content: bytes) -> Iterator[dict]:
    """Responses, revisits and resources of a WARC file, their payloads checked against their digests, and its problems."""
    stream, lost = _Unpacked(content), False
    while line := stream.readline():
        if not line.strip():
            continue
        at = stream.tell() - len(line)
        fields: dict[str, str] = {}
        if line.startswith(b"WARC/"):
            while (own := stream.readline()).strip():
                name, _, value = own.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not size.isdigit() or "warc-type" not in fields:
            if not lost:
                yield {"problem": f"no record here: {line[:200]!r}", "problem_at": at}
            lost = True
            continue
        lost, block, kind = False, stream.read(int(size)), fields["warc-type"]
        if len(block) < int(size):
            yield {"problem": f"{len(block)} of {size} bytes: {line[:200]!r}", "problem_at": at}
            continue
        if kind not in ("response", "revisit", "resource"):
            continue
        http, payload = _split_http(block)
        declared = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        same = None if kind == "revisit" else hashlib.sha1(payload).hexdigest() == declared
        size = int(fields[LENGTH_FIELD.lower()]) if kind == "revisit" else len(payload)
        yield {"key": _http_field(http, KEY_HEADER), "record_type": kind, "record_id": fields["warc-record-id"],
               "url": fields.get("warc-target-uri"), "date": fields["warc-date"], "payload_bytes": size,
               "payload_digest": declared, "refers_to": fields.get(REFERS_KEY_FIELD.lower()),
               "payload": None if kind == "revisit" else payload, "digest_ok": same, "problem": None}
    if stream.damage:
        yield {"problem": f"damaged file: {stream.damage}", "problem_at": stream.tell()}


def _read(spark: SparkSession, path: str, parse, schema: str, payloads: bool) -> DataFrame:
    names = ["file"] + [c.split()[0] for c in schema.split(", ")]
    dropped = [] if payloads else ["payload"] + ["http"] * ("http" in names)

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["file"], frame["content"], strict=True):
                rows, held = [], 0
                for record in parse(content):
                    held += len(record.get("payload") or b"")
                    rows.append({"file": file, **record, **dict.fromkeys(dropped)})
                    if held > 8_000_000:
                        yield _rows(rows, names)
                        rows, held = [], 0
                yield _rows(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.col("path").alias("file"), "content").mapInPandas(records, "file string, " + schema)


def _rows(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Plain values, as any of them may be missing."""
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.where(out.notna(), None)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per ARC record."""
    return _read(spark, path, arc_records, ARC_ROWS, payloads)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per WARC response, revisit or resource; a revisit's size and digest are those of the payload it stands for."""
    return _read(spark, path, warc_records, WARC_ROWS, payloads)


def _iso(date: Column) -> Column:
    """2024-01-02T03:04:05Z from the 14 digits (missing ones are the least of their kind)."""
    full = F.concat(date, F.substring(F.lit("00000101000000"), F.length(date) + 1, F.lit(14)))
    return F.regexp_replace(F.substring(full, F.lit(1), F.lit(14)), r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)",
                            "$1-$2-$3T$4:$5:$6Z")


def _base32(digest: Column) -> Column:
    """SHA-1 in hex as base32: 40 hex digits are 160 bits, so 32 letters of 5 bits."""
    bits = F.lpad(F.conv(F.substring(digest, 1, 10), 16, 2), 40, "0")
    for at in (11, 21, 31):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(digest, at, 10), 16, 2), 40, "0"))
    letter = lambda i: F.substring(
        F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, i * 5 + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(i) for i in range(32)])


def convert(
    spark: SparkSession, arc: str, warc: str, key_type: str = "bigint", least_bytes: int = LEAST_BYTES
) -> tuple[DataFrame, str]:
    """Reads ARC files below ``arc`` and writes WARC files below ``warc``. Keys compare as ``key_type``.

    Gives out the problems of the files read (file, problem, problem_at), and where that table is kept.
    """
    narrow = _read(spark, arc, _without_payload, ARC_ROWS + ", size bigint", True).select(
        "file", "key", "record_id", "url", "date", "digest", "size", "problem", "problem_at")
    index, kept_at = stage(narrow.filter((F.col("size") >= least_bytes) | F.col("problem").isNotNull()), "arc-index")
    groups = index.filter("problem IS NULL").groupBy("digest").agg(
        F.max(F.struct(F.col("key").cast(key_type).alias("order"), "key", "record_id", "url", "date")).alias("kept"),
        F.count("*").alias("copies"))
    copied, path = stage(groups.filter("copies > 1").select(F.col("digest").alias("_digest"), "kept"), "equal-payloads")
    rows = read_arc(spark, arc).filter("problem IS NULL")
    joined = rows.join(copied, (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") >= least_bytes), "left")
    revisit = F.col("kept").isNotNull() & ~F.col("key").eqNullSafe(F.col("kept.key"))
    is_http = F.octet_length("http") > 0
    kind = F.when(revisit, "revisit").when(is_http, "response").otherwise("resource")
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    content = F.when(is_http, "application/http; msgtype=response").otherwise(F.col("mime"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    digest = F.concat(F.lit("sha1:"), _base32(F.col("digest")))
    only = lambda *parts: F.when(revisit, F.concat(*parts)).otherwise("")
    header = F.concat(
        F.lit(f"WARC/1.0{_CRLF}"), field("WARC-Type", F.col("kind")), field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", _iso(F.col("date"))), field("WARC-Target-URI", F.col("url")),
        field("WARC-IP-Address", F.col("ip")), field("WARC-Payload-Digest", digest),
        only(field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", F.col("kept.record_id")),
             field("WARC-Refers-To-Target-URI", F.col("kept.url")), field("WARC-Refers-To-Date", _iso(F.col("kept.date"))),
             field(REFERS_KEY_FIELD, F.coalesce(F.col("kept.key"), F.lit(""))),
             field(LENGTH_FIELD, F.octet_length("payload").cast("string"))),
        field("Content-Type", content), field("Content-Length", F.octet_length("block").cast("string")), F.lit(_CRLF))
    about = f"software: corpus operators{_CRLF}format: WARC File Format 1.0{_CRLF}"
    own_id = F.regexp_replace(F.substring(F.sha1(F.concat(F.lit("warcinfo "), "record_id")), 1, 32),
                              "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    info = F.concat(
        F.lit(f"WARC/1.0{_CRLF}WARC-Type: warcinfo{_CRLF}WARC-Record-ID: <urn:uuid:"), own_id,
        F.lit(f">{_CRLF}WARC-Date: "), _iso(F.col("date")),
        F.lit(f"{_CRLF}Content-Type: application/warc-fields{_CRLF}Content-Length: {len(about)}{_END}{about}{_END}"))
    built = joined.withColumns({"kind": kind, "block": block})
    value = F.concat(F.when(_first_of_file(), info).otherwise(""), header, F.col("block").cast("string"))
    built.select(value.alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(warc)
    discard(spark, path)
    return index.filter("problem IS NOT NULL").select("file", "problem", "problem_at"), kept_at


def _without_payload(content: bytes) -> Iterator[dict]:
    for record in arc_records(content):
        payload = record.get("payload") or b""
        yield {**record, "size": len(payload), "payload": None, "http": None}


def archived(rows: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> tuple[DataFrame, str]:
    """Writes the rows as ARC, converts them to WARC and reads that back (without payloads); also the WARC folder."""
    spark = rows.sparkSession
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    write_arc(rows, arc, key, url, body)
    _, index = convert(spark, arc, warc, rows.schema[key].dataType.simpleString())
    discard(spark, arc, index)  # files just written have no problems
    return read_warc(spark, warc, payloads=False), warc
