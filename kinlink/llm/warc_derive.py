"""WARC derivatives: responses to linked metadata and plain-text conversion records.

For each response record two records are made. The metadata record (application/warc-fields) describes the response: its HTTP status and headers as they were, its digests, title, links. The conversion record holds the visible text. Both carry WARC-Refers-To with the response's identifier, its target and its date, and WARC-Concurrent-To with each other's identifier; identifiers are name-based, so reruns make the same records.

Files are read record by record. What is no whole record becomes a row of type malformed that says why.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_module
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VERSION = "WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
DATE = "1970-01-01T00:00:00Z"  # of pages that come without a date
SOFTWARE = "kinlink"

SEPARATOR = b"\r\n\r\nWARC/"  # between records

# Elements whose text is not visible, and those that break lines.
RAW = frozenset("script style noscript template".split())
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav footer header aside blockquote pre form main td th body title".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*RAW, "title")}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*+)))?")
_CHARSET = re.compile(r"content-type:.*charset=\"?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join((kind, *parts)))}>"


def pack(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One record as it stands in a file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


Headers = list[tuple[str, str]]


class Reader:
    """Records from the parts between separators. A part that is shorter than its Content-Length says goes on in the next one of the same file, as a separator may stand in a block."""

    def __init__(self):
        self.held, self.file = None, None

    def feed(self, part: bytes, file: str | None = None) -> Iterator[tuple[Headers, bytes, str | None]]:
        """The records that end with this part: headers, block, and what is wrong with them, if anything."""
        if self.held is not None:
            joined = self.held + SEPARATOR + part
            if file == self.file and self.missing(joined) >= 0:
                part = joined
            else:
                yield from self.end()
            self.held = None
        if self.missing(part) > 0:
            self.held, self.file = part, file
        else:
            yield self.record(part)

    def end(self) -> Iterator[tuple[Headers, bytes, str | None]]:
        if self.held is not None:
            yield self.record(self.held)
            self.held = None

    @staticmethod
    def parts(part: bytes) -> tuple[Headers, int | None, bytes]:
        head, _, block = part.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)]
        said = next((v for k, v in headers if k.lower() == "content-length"), "")
        return headers, int(said) if said.isdecimal() else None, block

    @classmethod
    def missing(cls, part: bytes) -> int:
        """How many bytes a part lacks of its block; below 0 if it has more than that."""
        _, length, block = cls.parts(part)
        return 0 if length is None else length - len(block.rstrip(b"\r\n") if len(block) > length else block)

    @classmethod
    def record(cls, part: bytes) -> tuple[Headers, bytes, str | None]:
        headers, length, block = cls.parts(part)
        if not re.match(rb"(?:WARC/)?\d", part):
            return headers, part, "no version line"
        if length is None:
            return headers, block, "no Content-Length"
        if len(block) < length:
            return headers, block, f"{len(block)} of {length} bytes"
        if block[length:].strip(b"\r\n"):
            return headers, block, f"more than {length} bytes"
        return headers, block[:length], None


def unpack(data: bytes) -> Iterator[tuple[Headers, bytes, str | None]]:
    """The records of a file's bytes."""
    reader = Reader()
    for part in data.split(SEPARATOR):
        if part.strip():
            yield from reader.feed(part)
    yield from reader.end()


def response(page_id: int | None, url: str | None, html: str | None) -> tuple[Headers, bytes]:
    """A page as the response record it would be in a crawl."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Length", str(len(block))),
    ]
    return headers, block


def _line(value: str | None) -> str:
    """A value that can stand in a header line."""
    return " ".join((value or "").split())


def scan(html: str) -> tuple[str, str, list[str]]:
    """The visible text, one line per block; the title; and the targets of links, in one pass. What is not closed goes to the end of the page."""
    out: list[str] = []
    links: list[str] = []
    title, at, n, in_head, tag_of = "", 0, len(html), False, _TAG
    while at < n:
        i = html.find("<", at)
        if i < 0:
            i = n
        if not in_head:
            out.append(html[at:i])
        if i == n:
            break
        ahead = html[i + 1 : i + 2]
        if html.startswith("<!--", i) or ahead in ("!", "?"):
            comment = html.startswith("<!--", i)
            end = html.find("-->" if comment else ">", i + 2)
            out.append(" " if comment else "")
            at = end + (3 if comment else 1) if end >= 0 else n
            continue
        if not (ahead == "/" or ahead.isascii() and ahead.isalpha()):
            out.append("" if in_head else "<")
            at = i + 1
            continue
        found = tag_of.match(html, i)
        if not found and tag_of is _TAG:  # a quote is open to the end: from here on quotes do not count
            tag_of = _PLAIN_TAG
            found = tag_of.match(html, i)
        if not found:
            end = html.find(">", i)
            at = end + 1 if end >= 0 else n
            continue
        closing, name, rest = found[1] == "/", found[2].lower(), found[3]
        at = found.end()
        if name in _CLOSE and not closing:
            end = _CLOSE[name].search(html, at)
            if name == "title":
                inner = _line(html_module.unescape(html[at : end.start() if end else n]))
                title = title or inner
            out.append(" ")
            at = end.end() if end else n
        elif name == "head":
            in_head = not closing
        elif name in BREAKS:
            in_head = in_head and name != "body"
            out.append("\n")
        if name == "a" and not closing:
            hrefs = (x.group(2, 3, 4) for x in _ATTRIBUTE.finditer(rest) if x[1].lower() == "href" and x.group(2, 3, 4) != (None,) * 3)
            links += [_line(html_module.unescape(next(filter(None, x), ""))) for x in itertools.islice(hrefs, 1)]
    lines = (" ".join(x.split()) for x in html_module.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, links


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of one response."""
    own = {k.lower(): v for k, v in headers}
    source, target, date = own["warc-record-id"], own.get("warc-target-uri", ""), own.get("warc-date", DATE)
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    charset = next((m[1] for x in http if (m := _CHARSET.match(x))), "utf-8")
    try:
        html = payload.decode(charset, "replace")
    except LookupError:
        html = payload.decode("utf-8", "replace")
    text, title, links = scan(html)
    payload_digest = own.get("warc-payload-digest", digest(payload))
    fields = [
        ("software", SOFTWARE),
        ("http-status", _line(status)),
        *(("http-header", _line(x)) for x in http),
        ("source-content-type", own.get("content-type", "")),
        ("source-content-length", own.get("content-length", str(len(block)))),
        ("source-payload-digest", payload_digest),
        ("source-block-digest", own.get("warc-block-digest", digest(block))),
        ("title", title),
        *(("outlink", x) for x in links),
    ]
    bodies = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")),
        "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")),
    }
    ids = {kind: record_id(kind, source) for kind in bodies}
    out = []
    for kind, (content, body) in bodies.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        out.append(
            (
                [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", ids[kind]),
                    ("WARC-Refers-To", source),
                    ("WARC-Refers-To-Target-URI", target),
                    ("WARC-Refers-To-Date", date),
                    ("WARC-Concurrent-To", other),
                    ("WARC-Target-URI", target),
                    ("WARC-Date", date),
                    ("WARC-Source-Payload-Digest", payload_digest),
                    ("Content-Type", content),
                    ("WARC-Block-Digest", digest(body)),
                    ("Content-Length", str(len(body))),
                ],
                body,
            )
        )
    return out


_SCHEMA = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "payload_digest", "block_digest")), ("content_length", pa.int64()), ("block", pa.binary()), ("problem", pa.string())])
_SQL = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long, block binary, problem string"
_FIELDS = ("warc-type", "warc-record-id", "warc-refers-to", "warc-concurrent-to", "warc-target-uri", "warc-date", "content-type")


def _row(page_id, headers, block, problem=None) -> tuple:
    own = {k.lower(): v for k, v in headers}
    kind, *fields = (own.get(f) for f in _FIELDS)
    payload = own.get("warc-payload-digest", own.get("warc-source-payload-digest"))
    return (page_id, "malformed" if problem else kind, *fields, payload, own.get("warc-block-digest"), len(block), block, problem)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA.types)], schema=_SCHEMA)


def _derive_pages(with_response: bool, step: int = 256):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = []
                for page_id, url, html in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist()):
                    source = response(page_id, url, html)
                    rows += [_row(page_id, *x) for x in ([source] if with_response else []) + derive(*source)]
                yield _emit(rows)

    return run


def derivatives(pages: DataFrame, with_response: bool = False) -> DataFrame:
    """The metadata and the conversion record of each page's response, with their blocks; with_response adds the responses themselves.

    A null or empty html is a response with an empty payload, a null url an empty target; page_id may be null. Repeated rows have equal records with equal identifiers, as often as they come. Pages of any length are taken whole. Columns other than page_id, url and html are ignored. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_derive_pages(with_response), _SQL)


def _derive_files(batches):
    reader = Reader()

    def rows(records):
        for headers, block, problem in records:
            own = {k.lower(): v for k, v in headers}
            if not problem and own.get("warc-type") == "response" and not own.get("warc-record-id"):
                problem = "no WARC-Record-ID"
            if problem:
                yield _row(None, headers, block, problem)
            elif own.get("warc-type") == "response":
                yield from (_row(None, *x) for x in derive(headers, block))

    for batch in batches:
        for part, file in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist()):
            if part.strip():
                made = list(rows(reader.feed(part, file)))
                if made:
                    yield _emit(made)
    yield _emit(list(rows(reader.end())))


def derivatives_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from WARC files, plain or gzipped (.gz); records other than responses are passed over.

    Spark's text source reads them, parted at what stands between two records, so a task holds a record at a time and plain files are shared by many tasks. Records that are cut short, have no Content-Length, version or identifier, are rows of type malformed with a problem; nothing raises.
    """
    parts = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary").alias("part"), F.col("_metadata.file_path").alias("file"))
    return parts.mapInArrow(_derive_files, _SQL)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))


QUERIES = {"op7_warc_derive": op7}
ORACLES: dict[str, str] = {}
