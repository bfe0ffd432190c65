"""WARC derivatives: metadata and plain-text conversion records that refer to response records.

A response record gives two records: ``metadata`` (JSON: status, source headers, title, links) and
``conversion`` (the page's visible text). Both have the response's target URI and date, its record id in
WARC-Refers-To, its digest in WARC-Refers-To-Digest, and their own id, length and block digest (SHA-1 in base
32). Ids are UUIDs of version 5 of what they name, so that a task that runs again writes the same records.

``responses`` makes response records of a table of pages; ``records_of`` reads the records of WARC files,
whole or gzipped member by member; ``warc_bytes`` writes one. All of it is local to a row.

Cases: a null HTML has an empty body and an empty conversion; a null URL has the target URI ``about:blank``;
a response without a blank line after its headers is all headers; undecodable bytes become U+FFFD; rows that
repeat have the same records; a null page_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = uuid.UUID("9a3c1d52-6a0e-5b52-8c0e-3f2b6f1d7a10")
SOFTWARE = "maskloom"
RECORD = "record_id string, type string, target_uri string, date string, refers_to string, content_type string, block_digest string, payload_digest string, length long, block binary"

_SKIP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript|svg)\b[^>]*>.*?(?:</\1\s*>|$)|<![^>]*>|<\?[^>]*>", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
#: Elements that begin and end a line.
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I
)
_TAG = re.compile(r"</?[A-Za-z][^>]*>")
_LINK = re.compile(r"<(a|area|link|img|iframe|script|form)\b[^>]*?\b(?:href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LINES = re.compile(r"[ \t\r\f\v\xa0]*\n\s*")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(names))}>"


def visible_text(page: str) -> str:
    """Text that a reader sees, a line for each block element, spaces squeezed."""
    page = _TAG.sub("", _BLOCK.sub("\n", _SKIP.sub("", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(page))).strip()


def outline(page: str) -> dict:
    """Title and links of a page."""
    bare = re.sub(r"<!--.*?(?:-->|$)", "", page, flags=re.S)
    title = _TITLE.search(bare)
    links = [{"tag": m[1].lower(), "url": entities.unescape(m[2] or m[3] or m[4] or "")} for m in _LINK.finditer(bare)]
    return {"title": _BLANKS.sub(" ", entities.unescape(title[1])).strip() if title else None, "links": links}


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, body."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines[1:]) if sep], body


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def unpacked(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without chunks and compression; as it stands where it isn't what its headers say."""
    said = {k.lower(): v.lower() for k, v in headers}
    try:
        if "chunked" in said.get("transfer-encoding", ""):
            body = _dechunked(body)
        coding = said.get("content-encoding", "")
        return zlib.decompress(body, 47) if coding in ("gzip", "x-gzip", "deflate") else body
    except (ValueError, zlib.error):
        return body


def _charset(headers: list[tuple[str, str]]) -> str:
    for k, v in headers:
        if k.lower() == "content-type" and (m := re.search(r"charset=\"?([\w.:-]+)", v, re.I)):
            try:
                return b"".decode(m[1]) or m[1]
            except LookupError:
                pass
    return "utf-8"


def derived(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    status, headers, body = split_response(record["block"])
    body = unpacked(headers, body)
    page = body.decode(_charset(headers), "replace")
    about = {"Envelope": {"WARC-Record-ID": record["record_id"], "WARC-Target-URI": record["target_uri"], "WARC-Date": record["date"], "WARC-Block-Digest": record["block_digest"], "WARC-Payload-Digest": record["payload_digest"]}, "HTTP-Status": status, "HTTP-Headers": headers, "HTML": outline(page)}
    out = []
    for kind, content, block in (
        ("metadata", "application/json", json.dumps(about, ensure_ascii=False, separators=(",", ":")).encode()),
        ("conversion", "text/plain", visible_text(page).encode("utf-8", "replace")),
    ):
        own = digest(block)
        out.append({
            "record_id": record_id(kind, record["record_id"], own), "type": kind, "target_uri": record["target_uri"], "date": record["date"], "refers_to": record["record_id"],
            "content_type": content, "block_digest": own, "payload_digest": record["payload_digest"], "length": len(block), "block": block,
        })
    return out


def warc_bytes(record: dict) -> bytes:
    """One record as it stands in a WARC 1.1 file."""
    head = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"])]
    if record.get("refers_to"):
        head += [("WARC-Refers-To", record["refers_to"]), ("WARC-Refers-To-Target-URI", record["target_uri"]), ("WARC-Refers-To-Date", record["date"]), ("WARC-Refers-To-Digest", record["payload_digest"])]
    elif record.get("payload_digest"):
        head.append(("WARC-Payload-Digest", record["payload_digest"]))
    head += [("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(record["length"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + record["block"] + b"\r\n\r\n"


def _members(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """The gzip members of a file, unpacked one at a time, each with its place; None is one that can't be read to its end."""
    at = 0
    while at < len(data):
        member, out = zlib.decompressobj(31), None
        try:
            out = member.decompress(data[at:])
            out = out + member.flush() if member.eof else None
        except zlib.error:
            out = None
        yield at, out
        at = len(data) - len(member.unused_data) if out is not None else data.find(b"\x1f\x8b\x08", at + 1)
        if at < 0:
            return


def _plain_records(data: bytes, offset: int) -> Iterator[dict]:
    stream = io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        said = head.get("content-length", "0")
        block = stream.read(int(said)) if said.isdigit() else None
        if block is None or len(block) < int(said):
            yield _unreadable(offset, f"a record of {said} bytes ends early")
            continue
        yield {
            "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"),
            "content_type": head.get("content-type"), "block_digest": head.get("warc-block-digest"), "payload_digest": head.get("warc-payload-digest") or head.get("warc-refers-to-digest"), "length": len(block), "block": block,
        }


def _unreadable(offset: int, why: str) -> dict:
    return dict.fromkeys(_NAMES) | {"type": "unreadable", "target_uri": f"{why}, member at byte {offset}"}


def records_in(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, also of one whose members are gzipped one by one. What can't be read is a record of
    type ``unreadable`` that says where; reading goes on with the next member."""
    for at, plain in _members(data) if data[:2] == b"\x1f\x8b" else [(0, data)]:
        if plain is None:
            yield _unreadable(at, "a broken member")
        else:
            yield from _plain_records(plain, at)


def page_response(page_id: int | None, url: str | None, page: str | None) -> dict:
    """A response record of a row of pages, whose date follows from page_id as the table has none."""
    body, uri = (page or "").encode("utf-8", "replace"), url or "about:blank"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    day, second = divmod(page_id or 0, 86400)
    date = f"2024-01-{1 + day % 28:02d}T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"
    payload = digest(body)
    block = head + body
    return {
        "record_id": record_id("response", str(page_id), uri, payload), "type": "response", "target_uri": uri, "date": date, "refers_to": None,
        "content_type": "application/http; msgtype=response", "block_digest": digest(block), "payload_digest": payload, "length": len(block), "block": block,
    }


_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = {"length": pa.int64(), "block": pa.binary()}


def _batch(rows: list[dict], more: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    types = (more or {}) | {n: _TYPES.get(n, pa.string()) for n in _NAMES}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in types.items()], list(types))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def responses(pages: DataFrame) -> DataFrame:
    """page_id and a response record for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            yield _batch([{"page_id": i} | page_response(i, u, h) for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True)], {"page_id": pa.int64()})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id long, {RECORD}")


def records_of(files: DataFrame) -> DataFrame:
    """path and the records of WARC files given as binaryFile rows (path, content); what can't be read has a record of type ``unreadable``.

    Spark gives a file as one row, so a file may have 2 GB at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, 1):
            held: list[dict] = []
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in records_in(content or b""):
                    held.append({"path": path} | r)
                    if len(held) == 256:
                        yield _batch(held, {"path": pa.string()})
                        held = []
            if held:
                yield _batch(held, {"path": pa.string()})

    return files.select("path", "content").mapInArrow(run, f"path string, {RECORD}")


def derivatives(records: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Metadata and conversion records of the response records among ``records``; ``keys``: columns to keep, with types."""
    keys = keys or {}
    kept = {k: {"long": pa.int64(), "string": pa.string()}[t] for k, t in keys.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            yield _batch([{k: r[k] for k in kept} | d for r in b.to_pylist() for d in derived(r)], kept)

    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), RECORD])
    return records.where("type = 'response' and block is not null").select(*keys, *_NAMES).mapInArrow(run, schema)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """page_id and two linked records for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            yield _batch([{"page_id": i} | d for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True) for d in derived(page_response(i, u, h))], {"page_id": pa.int64()})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id long, {RECORD}")
