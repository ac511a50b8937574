"""Derivatives of fetched card responses: metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|aside|form|title|head|body)\b|br\b)[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
# A tag is read once, to its end or that of the text, and its attributes inside it: no pattern looks twice at the same text.
_TITLE = re.compile(r"<title\b[^>]*(?:>|\Z)(.*?)(?:</title|\Z)", re.S | re.I)
_ANCHOR = re.compile(r"<a(?=[\s/>])([^>]*)", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)

#: Date of a record when neither a date of derivation nor one of the response is known, and bytes of records sent at a time.
NO_DATE, SENT = "1970-01-01T00:00:00Z", 8 << 20

SCHEMA = ("match_id {id}, warc_type string, record_id string, refers_to string, target_uri string, refers_to_date string, "
          "warc_date string, source_headers map<string,string>, source_payload_digest string, content_type string, "
          "payload_digest string, block_digest string, content_length long, block string, record binary")


def digest(data: bytes) -> str:
    """``sha1:`` and base 32, as WARC digests are written."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    """A record id that depends on the source record and the kind of derivative only."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} of {source}')}>"


def split_response(response: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, body) of an HTTP response; without status line all is body. Field names
    are lower case; repeated fields are joined by a comma, folded lines by a space."""
    if not response.startswith(b"HTTP/"):
        return {}, response
    head, gap, body = response.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    lines = head.decode("latin-1").split("\r\n")
    fields[":status"] = lines[0]
    name = None
    for line in lines[1:]:
        if line[:1] in " \t" and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon:
            name = None
            continue
        fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
    return fields, body


def decoded(body: bytes, fields: dict[str, str]) -> str:
    """The body as text by the charset of its header, else of its first tag that names one, else UTF-8."""
    named = _CHARSET.search(fields.get("content-type", "")) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(html: str) -> str:
    """All text of a page, a line per block, references decoded, white space joined."""
    text = _TAG.sub(" ", _BREAK.sub("\n", _SKIPPED.sub(" ", html)))
    lines = (" ".join(entities.unescape(x).split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def links(html: str) -> list[str]:
    """The ``href`` of every anchor that has one, in order: its first attribute of this very name."""
    found = []
    for tag in _ANCHOR.finditer(html):
        for name, *values in _ATTRIBUTE.findall(tag[1]):
            if name.lower() == "href":
                found.append(" ".join(entities.unescape("".join(values)).split()))
                break
    return found


def header_value(value: str) -> str:
    """A value that stays on its line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def bracketed(identifier: str) -> str:
    """A record id as WARC headers have it."""
    return identifier if not identifier or identifier.startswith("<") else f"<{identifier}>"


def metadata_fields(html: str, fields: dict[str, str], body: bytes) -> str:
    """``name: value`` lines on the response: title, charset of its header, size, links in order."""
    title = _TITLE.search(html)
    out = [("title", " ".join(entities.unescape(title[1]).split()) if title else ""),
           ("http-status", fields.get(":status", "")), ("http-content-type", fields.get("content-type", "")),
           ("body-length", str(len(body)))]
    out += [("outlink", link) for link in links(html)]
    return "".join(f"{k}: {header_value(v)}\r\n" for k, v in out)


def serialized(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *(f"{k}: {header_value(v)}" for k, v in headers), "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def build_derivatives(responses: DataFrame, match_id: str = "match_id", source_id: str = "record_id", uri: str = "target_uri",
                      fetched: str = "last_fetched", response: str = "response", derived: str | None = None) -> DataFrame:
    """Two records per fetched card response: ``metadata`` and ``conversion`` (plain text).

    ``response`` is the stored HTTP response (binary) or the bare body (text); ``source_id`` its record
    id, ``fetched`` its date. Each derivative names the response it comes from (``refers_to``, target
    URI and date), keeps the response's header fields and payload digest, has digests of its own, and
    comes as columns and as a serialised record. Ids follow from the source id, so reruns agree.
    ``derived`` is the date of derivation, which every record carries; without it, that of the response stands for it, else
    ``NO_DATE``. NULL response: an empty body; NULL source id: the record ids follow from the URI and the body instead; NULL id or URI: written as
    empty, the columns stay NULL; NULL date: no date of the response is written. Control characters in a value are
    percent-encoded, so none adds a header line. Repeated rows give repeated records. Row by row: nothing is shuffled, and
    records are sent on by size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            rows, size = [], 0
            types = [batch.schema.field(0).type, *[pa.string()] * 6, pa.map_(pa.string(), pa.string()),
                     *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
            for key, source, target, date, raw in zip(*(c.to_pylist() for c in batch.columns)):
                fields, body = split_response(raw or b"")
                html = decoded(body, fields)
                body_digest = digest(body)
                for kind, content_type, text in (("metadata", "application/warc-fields", metadata_fields(html, fields, body)),
                                                 ("conversion", "text/plain; charset=utf-8", plain_text(html))):
                    block = text.encode("utf-8", "replace")
                    own = record_id(kind, source if source is not None else f"{target or ''} {body_digest}")
                    own_digest, now = digest(block), derived or date or NO_DATE
                    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", now), ("WARC-Refers-To", bracketed(source or "")),
                            ("WARC-Target-URI", target or "")]
                    head += [("WARC-Refers-To-Date", date)] if date else []
                    head += [("WARC-Refers-To-Target-URI", target or ""), ("WARC-Source-Payload-Digest", body_digest)]
                    head += [("WARC-Source-Header", f"{k}={v}") for k, v in fields.items()]
                    head += [("WARC-Block-Digest", own_digest), ("WARC-Payload-Digest", own_digest),
                             ("Content-Type", content_type), ("Content-Length", str(len(block)))]
                    rows.append((key, kind, own, source, target, date, now, list(fields.items()), body_digest, content_type,
                                 own_digest, own_digest, len(block), text, serialized(head, block)))
                    size += 2 * len(block)
                if size > SENT:
                    yield sent(rows)
                    rows, size = [], 0
            if rows:
                yield sent(rows)

    names = [x.split()[0] for x in SCHEMA.format(id="_").split(", ")]
    rows = responses.select(F.col(match_id).alias("match_id"), F.col(source_id).cast("string").alias("source"),
                            F.col(uri).cast("string").alias("uri"), F.col(fetched).cast("string").alias("fetched"),
                            F.col(response).cast("binary").alias("response"))
    return rows.mapInArrow(run, SCHEMA.format(id=rows.schema["match_id"].dataType.simpleString()))
