"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

A response record becomes a ``metadata`` record (JSON: source headers, digests,
title, description, links) and a ``conversion`` record (the page's text). Both
name the response in WARC-Refers-To and keep its WARC-Target-URI and WARC-Date;
payload and block digests are SHA-1 in base 32, as is usual in WARC files.
Records can be written as WARC files with one gzip member to each record and
read back. A page is read once, from left to right, in time proportional to its
length, however its tags are broken. Control characters in a header's value (a
URL with a line end) are written in percent form, so a header stays one line.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm.token_frames import filesystem, store_settings

VERSION = "WARC/1.1"
#: Of the gzip members.
LEVEL = 6
#: A file ends with the record that reaches this size.
FILE_BYTES = 1 << 30
#: Written where a capture has no date of its own.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
#: Extension field that keeps the key of the page table.
PAGE_ID = "WARC-Page-ID"
#: The begin of a comment, or a tag. Tried only before a page's last ``>``, so that no tag that has begun can fail and
#: a page takes time in proportion to its length.
_MARK = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|(!--)|[!?/][^>]*>)")
#: Elements that are not shown: where each ends.
_HIDDEN = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template")}
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>?")
_BEGIN = re.compile(r"<[/!?a-zA-Z]")
_TITLE_END = re.compile(r"</title\s*>", re.I)
_LINKED = {"a", "link", "img", "script", "iframe"}
_BREAKS = set(
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main "
    "nav ol p pre section table tbody td th thead tr ul title head body".split()
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that follows from its parts, so that a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def attributes(tag: str) -> dict[str, str]:
    """Attributes of the inside of a start tag by lower-case name; of a repeated one the first."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), values[0] or values[1] or values[2])
    return found


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def read_page(page: str) -> tuple[str, dict]:
    """Visible text (a line to each block element, white space collapsed) and metadata of a page.

    Metadata are title, description and links (kind and target, in order). A tag
    ends at the next ``>``; a comment, hidden element or tag without an end
    reaches to the end of the page.
    """
    shown: list[str] = []
    links: list[dict] = []
    title = description = None
    at = 0
    for mark in _MARK.finditer(page, 0, page.rfind(">") + 1):
        start = mark.start()
        if start > at:
            shown.append(page[at:start])
        elif start < at:  # in what is hidden; it ends with a ">", where a tag inside ends at the latest
            continue
        at = mark.end()
        slash, name, rest, comment = mark.groups()
        if name is None:
            if comment:
                shown.append(" ")
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else len(page)
            continue
        name = name.lower()
        if name in _BREAKS:
            shown.append("\n")
        if slash:
            continue
        if name in _LINKED:
            own = attributes(rest)
            kind = "href" if "href" in own else "src"
            if kind in own:
                links.append({"path": f"{name}@/{kind}", "url": html.unescape(own[kind]).strip()})
        elif name == "title" and title is None:
            end = _TITLE_END.search(page, at)
            title = _clean(_TAG.sub("", page[at : end.start() if end else len(page)]))
        elif name == "meta" and description is None:
            own = attributes(rest)
            if own.get("name", "").lower() == "description" and "content" in own:
                description = _clean(own["content"])
        if name in _HIDDEN:
            shown.append(" ")
            end = _HIDDEN[name].search(page, at)
            at = end.end() if end else len(page)
    # a tag without an end, behind the last mark, is left out with what follows
    begun = _BEGIN.search(page, at)
    shown.append(page[at : begun.start()] if begun else page[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(shown)).split("\n"))
    return "\n".join(line for line in lines if line), {"title": title, "description": description, "links": links}


def page_text(page: str) -> str:
    return read_page(page)[0]


def page_metadata(page: str) -> dict:
    return read_page(page)[1]


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response block; a block without a header end is all payload."""
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return status, [(k.strip(), v.strip()) for k, _, v in pairs], payload


def response_block(page: str | None) -> bytes:
    payload = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


RECORD = "page_id long, kind string, record_id string, refers_to string, url string, headers map<string,string>, block binary"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]


def _plain(value: str) -> str:
    """A header's value with control characters in percent form."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value) if _CONTROL.search(value) else value


def _record(page_id, kind, own_id, refers_to, url, date, content_type, block, payload_digest) -> tuple:
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": own_id,
        "WARC-Target-URI": url,
        "WARC-Date": date,
        "Content-Type": content_type,
        "Content-Length": str(len(block)),
        "WARC-Block-Digest": digest(block),
        "WARC-Payload-Digest": payload_digest,
    }
    if refers_to:
        headers["WARC-Refers-To"] = refers_to
    if page_id is not None:
        headers[PAGE_ID] = str(page_id)
    headers = {k: _plain(v) for k, v in headers.items() if v is not None}
    return page_id, kind, own_id, refers_to, headers.get("WARC-Target-URI"), list(headers.items()), block


def _response(page_id: int | None, url: str | None, page: str | None, date: str) -> tuple[tuple, str]:
    """The response record of a captured page, and its payload's digest."""
    payload = digest((page or "").encode())
    own = record_id("response", str(page_id), url or "", payload)
    kind = "application/http; msgtype=response"
    return _record(page_id, "response", own, None, url, date, kind, response_block(page), payload), payload


def _derived(record: tuple, known_digest: str | None = None) -> Iterator[tuple]:
    """The metadata and conversion records of a response; ``known_digest`` is its payload's, where the caller has it."""
    page_id, _, own_id, _, url, headers, block = record
    status, http_headers, payload = parse_http(block or b"")
    source = dict(headers or [])
    date = source.get("WARC-Date", UNKNOWN_DATE)
    true_digest = known_digest or digest(payload)
    payload_digest = source.get("WARC-Payload-Digest") or true_digest
    text, found = read_page(payload.decode("utf-8", "replace"))
    envelope = {
        "WARC-Header": source,
        "HTTP-Response": {"Status-Line": status, "Headers": http_headers, "Entity-Length": len(payload)},
        "Payload-Digest": payload_digest,
        "Payload-Digest-Holds": payload_digest == true_digest,
        "HTML": found,
    }
    content = json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()
    own = record_id("metadata", own_id)
    yield _record(page_id, "metadata", own, own_id, url, date, "application/json", content, payload_digest)
    own = record_id("conversion", own_id)
    kind = "text/plain; charset=utf-8"
    yield _record(page_id, "conversion", own, own_id, url, date, kind, text.encode(), payload_digest)


def _rows(batches: Iterator[pa.RecordBatch], per_slice: int = 128) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, per_slice):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, per_slice).columns))


def _batches(records: Iterator[tuple], most_rows: int = 256, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Records as batches of bounded size."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record[-1])
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)


def _captures(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")


def responses(pages: DataFrame, date: str = UNKNOWN_DATE) -> DataFrame:
    """WARC response records of captured pages (page_id, url, html).

    A null url is left out of the headers, an empty one stays; control characters
    in it take percent form. Null html is an empty payload. Repeated rows give
    repeated records of the same ids. Other columns are ignored.
    """
    make = lambda batches: _batches(_response(*row, date)[0] for row in _rows(batches))
    return _captures(pages).mapInArrow(make, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response among ``records``; other kinds give none.

    A null block counts as empty. Repeated responses give repeated records of the
    same ids; an empty table gives none. Other columns are ignored.
    """
    make = lambda batches: _batches(r for row in _rows(batches) for r in _derived(row))
    return records.where("kind = 'response'").select(*_NAMES).mapInArrow(make, RECORD)


def to_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _write(df: DataFrame, records: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], path: str, file_bytes: int) -> DataFrame:
    """Write the (headers, block) pairs that ``records`` makes of each partition; the manifest."""
    if not re.match(r"\w+:", path):
        path = f"file://{os.path.abspath(path)}"
    settings = store_settings(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, (store, at) = TaskContext.get(), filesystem(path, settings)
        store.create_dir(at, recursive=True)
        own = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        stream, name, count, size, n = None, "", 0, 0, 0
        for headers, block in records(batches):
            if stream is None:
                name, count, size, n = f"{own}-{n:06d}.warc.gz", 0, 0, n + 1
                stream = store.open_output_stream(f"{at}/{name}", compression=None)
            member = gzip.compress(to_bytes(headers, block), LEVEL, mtime=0)
            stream.write(member)
            count, size = count + 1, size + len(member)
            if size >= file_bytes:
                stream.close()
                stream = None
                yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

    schema = "file string, records long, bytes long"
    df.mapInArrow(write, schema).write.parquet(f"{path}/manifest")
    return df.sparkSession.read.schema(schema).parquet(f"{path}/manifest")


def write_records(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records as ``part-*.warc.gz`` files below the new ``path``; (file, records, bytes) of each file.

    Each partition writes its records in their order, and begins a new file when
    one has reached ``file_bytes``; no file without records is written. A file
    has the attempt of its task in its name and counts only if the table
    ``manifest`` beside it lists it, so tasks may fail and run again.
    """
    pairs = lambda batches: _rows(batches)
    return _write(records.select("headers", "block"), pairs, path, file_bytes)


def write_derivatives(pages: DataFrame, path: str, date: str = UNKNOWN_DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``write_records`` of the ``derivatives`` of the ``responses`` of pages, in one pass over the pages as they lie."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row in _rows(batches):
            for record in _derived(*_response(*row, date)):
                yield record[-2:]

    return _write(_captures(pages), pairs, path, file_bytes)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files that the manifest below ``path`` lists; block digests are tested.

    Files are read as streams, one member at a time.
    """
    if not re.match(r"\w+:", path):
        path = f"file://{os.path.abspath(path)}"
    settings = store_settings(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (name,) in _rows(batches):
            store, at = filesystem(path, settings)
            with store.open_input_stream(f"{at}/{name}", compression=None, buffer_size=1 << 20) as stream:
                file = gzip.GzipFile(fileobj=stream)
                while file.readline():
                    headers = {}
                    while (line := file.readline()) != b"\r\n":
                        key, _, value = line[:-2].decode().partition(": ")
                        headers[key] = value
                    block = file.read(int(headers["Content-Length"]))
                    if headers["WARC-Block-Digest"] != digest(block) or file.read(4) != b"\r\n\r\n":
                        raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
                    yield (
                        int(headers[PAGE_ID]) if PAGE_ID in headers else None,
                        headers["WARC-Type"],
                        headers["WARC-Record-ID"],
                        headers.get("WARC-Refers-To"),
                        headers.get("WARC-Target-URI"),
                        list(headers.items()),
                        block,
                    )

    files = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest").select("file")
    read = lambda batches: _batches(records(batches))
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORD)
