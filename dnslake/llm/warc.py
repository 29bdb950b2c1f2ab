"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A record is a row: the named WARC fields as columns, the other header fields as they stood, and the block as
bytes.  ``derive`` makes of every response with an HTML payload

* a ``metadata`` record (application/warc-fields) that tells what the response was: status, media type, lengths,
  digests, charset, title, number of links;
* a ``conversion`` record (text/plain) with the text of the page.

Both bear WARC-Refers-To with the id of the response, WARC-Concurrent-To each other's id, and the response's target,
date and digests; their own block digests are SHA-1 in base32, as in public archives.  Ids are made from
what a record is of, so a repeated run and a lost executor give equal ids.

Records are written as gzip members, one per record, so a file can be cut and joined at members; each task
writes what it holds.  Reading is one record at a time.  Defined cases: a page with null URL or body gives a
response with an empty one, and its derivatives; a response without an HTTP head, or with another media type than HTML, gives the
metadata record alone; a cut record ends the file's records; a record without id gets none of the derivatives;
repeated pages are numbered and have ids of their own.
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

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dnslake.llm import textops
from dnslake.llm.htmlblocks import blocks

RECORD_SQL = ("warc_type string, record_id string, target_uri string, warc_date string, content_type string, refers_to string, "
              "concurrent_to string, block_digest string, payload_digest string, headers array<struct<name:string,value:string>>, "
              "block binary")
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
RECORD = pa.schema([*[(n, pa.string()) for n in (
    "warc_type", "record_id", "target_uri", "warc_date", "content_type", "refers_to", "concurrent_to", "block_digest",
    "payload_digest")], ("headers", _HEADERS), ("block", pa.binary())])
_NAMED = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "warc_date",
          "content-type": "content_type", "warc-refers-to": "refers_to", "warc-concurrent-to": "concurrent_to",
          "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest"}
_LINK = re.compile(rb"<a\s[^>]*href", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)
HTML_TYPES = ("text/html", "application/xhtml+xml")
VERSION = b"WARC/1.1"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*of: str) -> str:
    """An id that follows from what the record is of."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(of))}>"


def _row(**fields) -> dict:
    return {n: fields.get(n) for n in RECORD.names} | {"headers": fields.get("headers") or []}


# -- responses --------------------------------------------------------------------------------------

def responses(pages: DataFrame, date: str, page_id: str = "page_id") -> DataFrame:
    """Response records of stored pages (page_id, url, html), and page_id."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "html"):
                rows = [response(u or "", (h or "").encode(), date, f"{k}/{t}") for u, h, k, t in zip(
                    *(part.column(c).to_pylist() for c in ("url", "html", "key", "turn")))]
                record = pa.RecordBatch.from_pylist(rows, RECORD)
                yield pa.RecordBatch.from_arrays([*record.columns, part.column("page_id")], [*RECORD.names, "page_id"])

    # Only ids that stand on several rows need numbers; the rest have turn 0 without any sort.
    same = Window.partitionBy("page_id").orderBy(F.xxhash64("url", "html"), "url")
    ready = pages.select(F.col(page_id).alias("page_id"), "url", "html")
    several = ready.groupBy("page_id").count().where("count > 1").select("page_id", "count")
    marked = ready.join(several, ready.page_id.eqNullSafe(several.page_id), "left").select(ready["*"], "count")
    numbered = marked.where("count is null").withColumn("turn", F.lit(0)).unionByName(
        marked.where("count is not null").withColumn("turn", F.row_number().over(same)))
    return (numbered.select("page_id", "url", "html", F.col("page_id").cast("string").alias("key"), "turn")
            .mapInArrow(step, f"{RECORD_SQL}, page_id {dict(pages.dtypes)[page_id]}"))


def response(url: str, body: bytes, date: str, key: str) -> dict:
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n").encode()
    block = head + body
    return _row(warc_type="response", record_id=record_id("response", key, url, digest(block)), target_uri=url, warc_date=date,
                content_type="application/http; msgtype=response", block_digest=digest(block), payload_digest=digest(body),
                block=block)


# -- derivatives ------------------------------------------------------------------------------------

def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes] | None:
    """(status, headers, body) of an HTTP response; None where there is no head."""
    if not block.startswith(b"HTTP/"):
        return None
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    status = lines[0].split(" ")[1:2]
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and fields:  # a folded line goes on
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return int(status[0]) if status and status[0].isdigit() else None, fields, body


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip() if end >= 0 else b"0"
        if not re.fullmatch(rb"[0-9A-Fa-f]+", digits):
            return body  # not chunked after all
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2: end + 2 + size])
        at = end + 2 + size + 2


def payload(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content coding; a coding that cannot be undone is left."""
    named = {n.lower(): v.lower() for n, v in fields}
    if "chunked" in named.get("transfer-encoding", ""):
        body = _unchunked(body)
    try:
        if "gzip" in named.get("content-encoding", ""):
            return gzip.decompress(body)
        if "deflate" in named.get("content-encoding", ""):
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def derivatives(record: dict) -> list[dict]:
    """The metadata and conversion records of a response."""
    own = record["record_id"]
    if record["warc_type"] != "response" or not own:
        return []
    block = record["block"] or b""
    parsed = split_http(block)
    lines = [("source-content-length", len(block)), ("source-block-digest", record["block_digest"] or digest(block))]
    text = None
    if parsed:
        status, fields, body = parsed
        kind = next((v for n, v in fields if n.lower() == "content-type"), "")
        media = kind.split(";")[0].strip().lower()
        body = payload(fields, body)
        lines += [("http-status", status), ("media-type", media), ("payload-length", len(body)),
                  ("payload-digest", record["payload_digest"] or digest(body))]
        lines += [(f"http-{n.lower()}", v) for n, v in fields if n.lower() not in ("content-type",)]
        if media in HTML_TYPES:
            found = _CHARSET.search(kind) or _CHARSET.search(body[:2048].decode("latin-1"))
            charset = found[1].lower() if found else "utf-8"
            try:
                page = body.decode(charset, "replace")
            except LookupError:
                page = body.decode("utf-8", "replace")
            text = "\n".join(b.text for b in blocks(page, xml=media == "application/xhtml+xml"))
            title = _TITLE.search(page)
            lines += [("charset", charset), ("title", " ".join(title[1].split()) if title else None), ("links", len(_LINK.findall(body)))]
    fields_block = "".join(f"{n}: {' '.join(str(v).split())}\r\n" for n, v in lines if v is not None).encode()
    ids = {k: record_id(k, own) for k in ("metadata", "conversion")}
    shared = {k: record[k] for k in ("target_uri", "warc_date", "headers")} | {"refers_to": own}
    out = [_row(**shared, warc_type="metadata", record_id=ids["metadata"], content_type="application/warc-fields",
                concurrent_to=ids["conversion"] if text is not None else None, block=fields_block,
                block_digest=digest(fields_block), payload_digest=record["payload_digest"])]
    if text is not None:
        plain = text.encode()
        out.append(_row(**shared, warc_type="conversion", record_id=ids["conversion"], content_type="text/plain; charset=utf-8",
                        concurrent_to=ids["metadata"], block=plain, block_digest=digest(plain),
                        payload_digest=record["payload_digest"]))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records; columns of ``records`` that are no record fields are kept beside them."""
    extra = [f for f in records.schema if f.name not in RECORD.names]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                rows, source = [], []
                for i, record in enumerate(part.select(RECORD.names).to_pylist()):
                    made = derivatives(record)
                    rows += made
                    source += [i] * len(made)
                made = pa.RecordBatch.from_pylist(rows, RECORD)
                beside = [part.column(f.name).take(pa.array(source, pa.int64())) for f in extra]
                yield pa.RecordBatch.from_arrays([*made.columns, *beside], [*RECORD.names, *(f.name for f in extra)])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    return records.select(*RECORD.names, *[f.name for f in extra]).mapInArrow(step, RECORD_SQL + kinds)


# -- files ------------------------------------------------------------------------------------------

def record_bytes(record: dict) -> bytes:
    """One record as it stands in a file, uncompressed."""
    block = record["block"] or b""
    lines = [VERSION.decode()]
    for header, column in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"),
                           ("WARC-Date", "warc_date"), ("Content-Type", "content_type"), ("WARC-Refers-To", "refers_to"),
                           ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"),
                           ("WARC-Payload-Digest", "payload_digest")):
        if record[column]:
            lines.append(f"{header}: {record[column]}")
    lines += [f"{h['name']}: {h['value']}" for h in record["headers"] or []]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an uncompressed stream, one after another."""
    while True:
        line = stream.readline()
        while line and not line.strip():
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        record, length = _row(), None
        while (line := stream.readline()).strip():
            name, colon, value = line.decode("utf-8", "replace").strip().partition(":")
            if not colon:
                continue
            column = _NAMED.get(name.lower())
            if column:
                record[column] = value.strip()
            elif name.lower() == "content-length":
                length = int(value) if value.strip().isdigit() else None
            else:
                record["headers"].append({"name": name, "value": value.strip()})
        block = stream.read(length) if length is not None else b""
        if length is None or len(block) < length:
            return
        record["block"] = block
        yield record


def members(records: DataFrame) -> DataFrame:
    """record_id and member: each record as a gzip member of its own (no time stamp: equal input, equal bytes)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = batch.slice(start, 200).to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "record_id": pa.array([r["record_id"] for r in rows], pa.string()),
                    "member": pa.array([gzip.compress(record_bytes(r), mtime=0) for r in rows], pa.binary())})

    return records.select(*RECORD.names).mapInArrow(step, "record_id string, member binary")


def read_members(rows: DataFrame, column: str = "member") -> DataFrame:
    """Records of gzip members (or of whole small files read as binary)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(column).to_pylist():
                if raw:
                    opened = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                    yield pa.RecordBatch.from_pylist(list(parse_records(io.BufferedReader(opened))), RECORD)

    return rows.select(column).mapInArrow(step, RECORD_SQL)


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD_SQL)
