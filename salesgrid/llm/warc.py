"""WARC derivatives: metadata and plain-text conversion records of responses.

``responses`` turns a table of pages into response records (HTTP header and
payload, digests, a record id made from the content). ``derive`` gives two
records for each response: a ``metadata`` record (application/warc-fields:
title, language, charset, links, the source's HTTP header fields and digests,
the id of the conversion) and a ``conversion`` record (the text). Both refer to
the response by id, target URI and date. ``write_warc`` writes records as WARC
files, one a partition.

Each page is worked on alone, in time linear in its length: no shuffle, and memory
is bounded by a slice of an Arrow batch (or one longer page). Ids are name-based, so reruns and retried tasks give the same records.

Defined results: a null payload counts as empty; a null URL leaves the URI
fields out; rows equal in key, URL and payload give equal records; broken
markup gives the text that is left without its tags; an empty table gives no
records. Input columns other than the named ones are left out.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

VERSION = "WARC/1.1"
CRLF = "\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_HIDDEN = re.compile(r"<(script|style|noscript|template|svg)\b[^>]*>", re.I)
_HEAD = re.compile(r"<head\b[^>]*>", re.I)
_BREAK = frozenset({"br", "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "header",
                    "footer", "nav", "aside", "main", "blockquote", "pre", "title", "body", "html"})
_TAG = re.compile(r"<(?=[/!?a-zA-Z])/?([a-zA-Z][a-zA-Z0-9_]*)?[^>]*>")
_OPEN = re.compile(r"<[/!?a-zA-Z]")
_FIELD = re.compile(r"<(a|title|html|meta)\b[^>]*>", re.I)
_FIELD_OPEN = re.compile(r"<(a|title|html|meta)\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
_SPACES = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


# Patterns that go up to a ">" are only tried before the last one of a page: there each "<" that begins
# one finds its end and is not looked at again, so that broken markup takes linear time too.

def _closing(page: str, name: str, after: int) -> re.Match | None:
    return re.compile(rf"</{name}\s*>", re.I).search(page, after)


def _without(page: str, opening: re.Pattern, to_end: bool) -> str:
    """The page without elements that begin with ``opening``; one that does not end goes to the page's end, or stays."""
    out, end, last = [], 0, page.rfind(">") + 1
    while m := opening.search(page, end, last):
        close = _closing(page, m[1] if m.re.groups else "head", m.end())
        if not close and not to_end:
            break
        out.append(page[end:m.start()])
        end = close.end() if close else len(page)
    return "".join(out) + page[end:]


def shown(page: str) -> str:
    """The page without comments and elements that are never displayed."""
    return _without(_COMMENT.sub("", page), _HIDDEN, True)


def _blank(tag: re.Match) -> str:
    return "\n" if tag[1] and tag[1].lower() in _BREAK else ""


def visible_text(page: str) -> str:
    """The text that a reader of the page sees, one block a line."""
    body = _without(shown(page), _HEAD, False)
    last = body.rfind(">") + 1
    open_tag = _OPEN.search(body, last)
    rest = body[last:open_tag.start()] if open_tag else body[last:]
    text = _TAG.sub(_blank, body[:last]) + rest
    lines = (_SPACES.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def page_fields(page: str) -> list[tuple[str, str]]:
    """Title, language, charset and links of a page."""
    body = shown(page)
    last = body.rfind(">") + 1
    tail = _FIELD_OPEN.search(body, last)       # a tag that does not end
    found: dict[str, str | None] = {}
    links = []
    for m in (*_FIELD.finditer(body, 0, last), *([tail] if tail else [])):
        name, stop = m[1].lower(), len(body) if m is tail else m.end()
        if name == "a":
            if (h := _HREF.search(body, m.start(), stop)) and (v := _VALUE.match(body, h.end())):
                links.append(v[1] or v[2] or v[3] or "")
        elif name == "title":
            if "title" not in found and m is not tail:
                close = _closing(body, "title", stop)
                found["title"] = body[stop:close.start()] if close else None
        elif name == "html":
            if "language" not in found and (v := _LANG.search(body, m.start(), stop)):
                found["language"] = v[1]
        elif "charset" not in found and (v := _CHARSET.search(body, m.start(), stop)):
            found["charset"] = v[1]
    fields = [(k, one_line(html.unescape(found[k]))) for k in ("title", "language", "charset") if found.get(k) is not None]
    return fields + [("outlink", x) for x in (one_line(html.unescape(v)) for v in links) if x]


def header(kind: str, own: str, fields: list[tuple[str, str | None]], content_type: str, block: bytes) -> str:
    """The header lines of a record, without the empty line after them."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", own), *fields, ("WARC-Block-Digest", digest(block)),
             ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return CRLF.join([VERSION, *(f"{k}: {v}" for k, v in lines if v is not None)])


def responses(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html",
              date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """record_id, target_uri, warc_date, http_header and payload of response records from pages."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    length = F.octet_length(body).cast("string")
    name = F.concat_ws("\u0001", F.lit("response"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")),
                       F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), F.sha1(body.cast("binary")))
    hexed = F.md5(name)
    ident = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[hexed.substr(a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    length)
    return pages.select(ident.alias("record_id"), F.col(f"`{url}`").cast("string").alias("target_uri"),
                        F.lit(date).alias("warc_date"), http.alias("http_header"), body.alias("payload"))


_RECORD = ("record_id string, warc_type string, refers_to string, target_uri string, warc_date string, "
           "source_payload_digest string, block_digest string, content_length long, header string, block string")


def _derived(own: str, uri: str | None, date: str, http: str, payload: str) -> list[tuple]:
    raw = payload.encode()
    source_digest = digest(raw)
    block_digest = digest((http + CRLF + CRLF).encode() + raw)
    text = visible_text(payload).encode()
    conversion, metadata = record_id("conversion", own), record_id("metadata", own)
    uri = uri if uri is None else one_line(uri)     # a line end would end the header field
    back = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", own),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    fields = [("conversion-record", conversion), ("source-payload-digest", source_digest),
              ("source-block-digest", block_digest), ("source-payload-length", str(len(raw)))]
    status, *http_fields = http.split(CRLF)
    fields.append(("source-status", status))
    fields += [("source-header", one_line(x)) for x in http_fields if x]
    fields += page_fields(payload)
    block = "".join(f"{k}: {v}{CRLF}" for k, v in fields).encode()
    meta = header("metadata", metadata, back, "application/warc-fields", block)
    conv = header("conversion", conversion, [*back, ("WARC-Payload-Digest", digest(text)),
                                             ("WARC-Source-Payload-Digest", source_digest)],
                  "text/plain; charset=utf-8", text)
    return [(metadata, "metadata", own, uri, date, source_digest, digest(block), len(block), meta, block.decode()),
            (conversion, "conversion", own, uri, date, source_digest, digest(text), len(text), conv, text.decode())]


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response record."""
    schema = pa.schema([(f.split()[0], {"long": pa.int64()}.get(f.split()[1], pa.string()))
                        for f in _RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in textops.slices(batch, "payload")):
            columns = [piece.column(c).to_pylist()
                       for c in ("record_id", "target_uri", "warc_date", "http_header", "payload")]
            out = [r for row in zip(*columns) for r in _derived(*row)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return records.select("record_id", "target_uri", "warc_date", F.coalesce("http_header", F.lit(""))
                          .alias("http_header"), F.coalesce("payload", F.lit("")).alias("payload")) \
        .mapInArrow(run, _RECORD)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write (header, block) rows as WARC files: header, empty line, block, two line ends."""
    body = F.concat("header", F.lit(CRLF + CRLF), "block")
    records.select(body.alias("value")).write.option("lineSep", CRLF + CRLF) \
        .option("compression", compression).text(path)
