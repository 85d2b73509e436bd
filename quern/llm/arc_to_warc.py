"""WARC: conversion of legacy ARC archives."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.shared import map_arrow, need, table

SCHEMA = "archive string, offset long, arc_version int, warc_type string, record_id string, date string, target_uri string, ip_address string, content_type string, block_digest string, payload_digest string, content_length long, http_status int, header string, block binary, error string"
_FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length")}
_STATUS = re.compile(rb"HTTP/\d\.\d (\d{3})")
_SPACE = uuid.UUID("9a3c6f0e-3a55-5f0f-8d0e-6f6b9a1f7c11")
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _date(text: str) -> str | None:
    """The 12 or 14 digits of an ARC date as a WARC date."""
    digits = text.ljust(14, "0") if text.isascii() and text.isdigit() and len(text) in (12, 14) else ""
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def _fields(line: bytes, version: int) -> dict[str, str]:
    """Fields of a header line of this version; blanks in a URL are kept, since the rest is counted from the end."""
    names = _FIELDS[version]
    parts = line.decode("utf-8", "replace").split(" ")
    if len(parts) < len(names):
        raise ValueError(f"header line has {len(parts)} fields; version {version} has {len(names)}")
    rest = len(names) - 1
    return dict(zip(names, [" ".join(parts[:-rest]), *parts[-rest:]]))


#: Lines that look like a header of each version: a scheme, and from the end length, fields and date.
_HEADERS = {v: re.compile(rb"^[A-Za-z][A-Za-z0-9+.-]*:[^\n]* (\d{12}|\d{14})(?: [^\n ]*){%d} (\d{1,18})\r?\n" % (len(names) - 4), re.M) for v, names in _FIELDS.items()}


def _ends(data: bytes, at: int) -> bool:
    """Whether a block may end here: at the archive's end or a line's."""
    return at == len(data) or data[at : at + 1] in (b"\n", b"\r")


def _next_header(data: bytes, at: int, version: int) -> int:
    """Where the next header line begins whose date can be read and whose block ends where a block may, else the archive's end."""
    for m in _HEADERS[version].finditer(data, at):
        if _date(m[1].decode()) and _ends(data, m.end() + int(m[2])):
            return m.start()
    return len(data)


def convert_archive(archive: str | None, content: bytes | None) -> Iterator[dict]:
    """WARC records of one ARC archive.

    The first record, filedesc://, states the version in its block's first line and becomes a warcinfo
    record; http(s) records whose block begins with a status line become responses, all others resources.
    Header lines are read by the version's fields and blocks by the declared length alone, whatever they
    hold.  What can't be read (a bad line or length, a block cut short) gives one record of type 'error'
    with the cause.  After a bad date reading goes on behind the block, if its length holds; after all else, and
    where the length doesn't hold, at the next line that is a header of the version.  Only an archive whose
    version can't be read ends there.
    """
    data, at, version = content or b"", 0, 0
    name = archive or ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        record = dict.fromkeys(_ARROW.names) | {"archive": archive, "offset": at, "arc_version": version or None}
        end = data.find(b"\n", at)
        after = None  # where the block ends
        try:
            if end < 0:
                raise ValueError("header line has no end")
            line = data[at:end].rstrip(b"\r")
            if not version:
                if not line.startswith(b"filedesc://"):
                    raise ValueError("archive doesn't begin with filedesc://")
                parts = data[end + 1 : end + 200].split(b"\n", 1)[0].split(b" ")
                version = int(parts[0]) if parts[0] in (b"1", b"2") else 0
                if not version:
                    raise ValueError("unknown version")
                record["arc_version"] = version
                # the filedesc line itself has five fields in version 1 and ten in version 2, or five in both
                f = _fields(line, version if len(line.split(b" ")) >= len(_FIELDS[version]) else 1)
            else:
                f = _fields(line, version)
            if not (f["length"].isascii() and f["length"].isdigit()):
                raise ValueError(f"length {f['length']!r} is not a number")
            size = int(f["length"])
            block = data[end + 1 : end + 1 + size]
            if len(block) < size:
                raise ValueError(f"block has {len(block)} of {size} bytes")
            after = end + 1 + size
            date = _date(f["date"])
            if date is None:
                raise ValueError(f"date {f['date']!r} can't be read")
            payload, status, kind = block, None, "resource"
            if f["url"].startswith("filedesc://"):
                kind, mime = "warcinfo", "application/warc-fields"
                block = f"software: quern\r\nformat: WARC File Format 1.0\r\nfilename: {f['url'][11:]}\r\n".encode()
                payload = block
            elif f["url"].startswith(("http://", "https://")) and (m := _STATUS.match(block)):
                kind, mime, status = "response", "application/http; msgtype=response", int(m[1])
                cut = [(i, n) for s, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(s)) >= 0]
                i, n = min(cut, default=(len(block), 0))
                payload = block[i + n :]
            else:
                mime = f["type"] if f["type"] not in ("", "-") else "application/octet-stream"
            own = _digest(block)
            ident = uuid.uuid5(_SPACE, f"{name}\0{at}\0{f['url']}\0{own}")
            head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", date)]
            ip = f["ip"] if f["ip"] not in ("", "-", "0.0.0.0") else None
            if kind == "warcinfo":
                head.append(("WARC-Filename", f["url"][11:]))
            else:
                head += [("WARC-Target-URI", f["url"])] + [("WARC-IP-Address", ip)] * bool(ip)
            whole = _digest(payload) if payload is not block else own
            head += [("WARC-Block-Digest", own)] + [("WARC-Payload-Digest", whole)] * (kind == "response")
            head += [("Content-Type", mime), ("Content-Length", str(len(block)))]
            record |= {
                "warc_type": kind, "record_id": f"urn:uuid:{ident}", "date": date, "target_uri": None if kind == "warcinfo" else f["url"], "ip_address": ip if kind != "warcinfo" else None,
                "content_type": mime, "block_digest": own, "payload_digest": whole if kind == "response" else None, "content_length": len(block), "http_status": status,
                "header": "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n", "block": block,
            }
            at = after
        except ValueError as e:
            yield record | {"warc_type": "error", "error": str(e)}
            if not version or end < 0:
                return
            at = after if after is not None and _ends(data, after) else _next_header(data, end + 1, version)
            continue
        yield record


def warc_bytes(header: str, block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return header.encode() + block + b"\r\n\r\n"


def arc_to_warc(archives: DataFrame, archive: str = "archive", content: str = "content") -> DataFrame:
    """WARC records of ARC archives, a row each (for instance those of the binaryFile source).

    A null or empty archive has no records; a null name counts as an empty one in identifiers; archives that occur twice are
    converted twice, with the same identifiers; an empty table gives an empty result; other columns are
    ignored.  Archives are converted one by one where they are read, without a shuffle.
    """

    def work(it):
        for batch in it:
            rows, size = [], 0
            for name, data in zip(batch.column(0), batch.column(1)):
                for r in convert_archive(name.as_py(), data.as_py()):
                    rows.append(r)
                    size += len(r["block"] or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return map_arrow(need(archives, archive, content), work, SCHEMA)


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, code: str = "200", name: str = "-", offset: int = 0) -> bytes:
    """A record of an ARC archive with the header line of this version."""
    line = f"{url} {ip} {date} {mime} {len(block)}" if version == 1 else f"{url} {ip} {date} {mime} {code} {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}"
    return line.encode() + b"\n" + block + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The filedesc record that begins an archive."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    block = f"{version} 0 quern\n{names}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", block, name=name)


#: Pages are put into archives of about this many bytes.
ARCHIVE_BYTES = 1 << 20


def pages_as_arc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) that hold the rows of `pages`, of version 1 and 2 by turns.

    The address and time that a page lacks follow from its page_id.  A null URL is written as
    unknown://page_id, a null text as an empty page.
    """

    def work(it):
        for batch in it:
            records, size, first, version = [], 0, None, 1
            ids, urls, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                page, url, html = ids[i].as_py(), urls[i].as_py(), texts[i].as_py() or ""
                k = page or 0
                if not records:
                    first, version = page, 1 + k % 2
                date = datetime.fromtimestamp(946684800 + 61 * (k % 10**7), UTC).strftime("%Y%m%d%H%M%S")
                body = html.encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                records.append(arc_record(version, (url or f"unknown://{page}").replace("\n", "%0A"), f"10.{k >> 16 & 255}.{k >> 8 & 255}.{k & 255}", date, "text/html", block, name="pages", offset=size))
                size += len(records[-1])
                if size >= archive_bytes or i == batch.num_rows - 1:
                    name = f"pages-{first}.arc"
                    yield pa.RecordBatch.from_pydict({"archive": [name], "content": [arc_head(version, name, "20000101000000") + b"".join(records)]})
                    records, size = [], 0

    return map_arrow(need(pages, "page_id", "url", "html"), work, "archive string, content binary")


def op10_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, archived as ARC and converted."""
    return arc_to_warc(pages_as_arc(table(spark, sf_dir, "pages")))


QUERIES = {"op10_arc_to_warc": op10_arc_to_warc}
ORACLE_SQL: dict[str, str] = {}
