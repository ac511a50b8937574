import base64
import hashlib
import time
from html.parser import HTMLParser
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from cardloom.llm import chat, queries, warc

TURNS = "pull_id long, row_index int, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "\x1b", "\x1b\x1b</s>", "<<SYS>>", "<<s>>", "[\x1bINST]", "<</SYS>\x1b>", "", " lead and trail ",
          "<|endoftext|>", "日本\U0001f600", "\n\n", "</s", "<s></s><s>"]


@given(st.text(alphabet="<>/s[]INTSYROLEX\x1b ab", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_mark(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(m in escaped for m in chat.MARKS)


def _want(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for k, v in by.items():
        v.sort(key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in v)
        loss = "".join(r[3] or "" for r in v if r[2] == "assistant")
        out[k] = (len(v), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_dialogues_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "system", "tool", "[INST]", None)[i % 6], t) for i, t in enumerate(TRICKY * 3)]
    rows += [(2, 0, "assistant", None), (None, 1, "user", "q"), (None, 2, "assistant", "a"), (3, None, "user", "first"), (3, 0, "assistant", "x" * 200000),
             (4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "tie")]
    rows += [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], TURNS + ", loss int").repartition(5)
    got = {r["pull_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_dialogues(df)).collect()}
    assert got == _want(rows)
    assert chat.read_back(chat.format_dialogues(spark.createDataFrame([], TURNS))).collect() == []


def test_tokens_marks_and_mask(spark):
    rows = [(1, 0, "user", "</s>hi"), (1, 1, "assistant", "[INST] yes")]
    got = chat.format_dialogues(spark.createDataFrame(rows, TURNS)).orderBy("turn").collect()
    _, decode, reserved = chat.codec()
    assert [r["start"] for r in got] == [0, len(got[0]["ids"])]
    assert sum(got[0]["loss"]) == 0 and [i for i in got[0]["ids"] if i >= reserved] == [reserved + chat.USER, reserved + chat.USER_END]
    under = [i for i, m in zip(got[1]["ids"], got[1]["loss"]) if m]
    assert len(under) == len(got[1]["ids"]) - 2 and max(under) < reserved
    assert chat.unescape(decode(np.array(under))) == "[INST] yes"


RESPONSES = "match_id string, record_id string, target_uri string, last_fetched string, response binary"
HTML = ("<html><head><title>Card &amp; set</title><script>var x='<p>no</p>'</script></head><body><h1>Card</h1><p>One <b>two</b>"
        "<br>three &eacute;</p><a href='/a?b=1&amp;c=2'>go</a><!-- gone --></body></html>")


def test_derivatives_link_to_their_response(spark):
    raw = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-A: 1\r\nx-a: 2\r\n more\r\n\r\n" + HTML.encode()
    rows = [("sv1-1", "urn:r:1", "http://x/1", "2026-01-02T03:04:05Z", bytearray(raw)), ("sv1-2", "urn:r:2", None, None, bytearray(b"plain")),
            ("sv1-3", None, "http://x/3", None, None), (None, "urn:r:4", "http://x/4", None, bytearray(b"HTTP/1.0 404\r\n\r\n"))]
    got = warc.build_derivatives(spark.createDataFrame([(*r, 1) for r in rows], RESPONSES + ", block int")).collect()
    assert len(got) == 8 and len({r["record_id"] for r in got}) == 8
    by = {(r["match_id"], r["warc_type"]): r for r in got}
    text, meta = by["sv1-1", "conversion"], by["sv1-1", "metadata"]
    assert text["block"] == "Card & set\nCard\nOne two\nthree é\ngo"
    assert meta["block"].startswith("title: Card & set\r\n") and "outlink: /a?b=1&c=2\r\n" in meta["block"]
    assert text["source_headers"] == {":status": "HTTP/1.1 200 OK", "content-type": "text/html; charset=utf-8", "x-a": "1, 2 more"}
    body = "sha1:" + base64.b32encode(hashlib.sha1(HTML.encode()).digest()).decode()
    for r in (text, meta):
        assert r["refers_to"] == "urn:r:1" and r["refers_to_date"] == "2026-01-02T03:04:05Z" and r["source_payload_digest"] == body
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"].encode()).digest()).decode()
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if not x.startswith("WARC-Source-Header"))
        assert block == r["block"].encode() + b"\r\n\r\n" and int(fields["Content-Length"]) == r["content_length"] == len(r["block"].encode())
        assert fields["WARC-Refers-To"] == "<urn:r:1>" and fields["WARC-Date"] == "2026-01-02T03:04:05Z" and fields["WARC-Record-ID"] == r["record_id"] and fields["WARC-Type"] == r["warc_type"]
    assert by["sv1-2", "conversion"]["block"] == "plain" and by["sv1-3", "conversion"]["block"] == "" and by[None, "conversion"]["block"] == ""
    again = warc.build_derivatives(spark.createDataFrame(rows, RESPONSES)).collect()
    assert {r["record_id"] for r in again} == {r["record_id"] for r in got}
    assert warc.build_derivatives(spark.createDataFrame([], RESPONSES)).collect() == []


def test_charsets_and_long_pages():
    assert warc.decoded("é".encode("latin-1"), {"content-type": "text/html; charset=ISO-8859-1"}) == "é"
    assert warc.decoded(b"<meta charset=latin-1>\xe9", {})[-1] == "é" and warc.decoded(b"x", {"content-type": "charset=nope"}) == "x"
    assert warc.plain_text("<p>" + "word " * 200000 + "<p").count("word") == 200000


class _Twin(HTMLParser):
    """Title and anchors of a page by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.outlinks, self.title, self.inside = [], "", False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title" or self.inside
        if tag == "a":
            found = [v or "" for n, v in attrs if n == "href"]
            self.outlinks += [" ".join(found[0].split())] if found else []

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "title"

    def handle_data(self, data):
        self.title += data if self.inside else ""


def _parsed(record):
    """(header fields in order, block) of a serialised record, by its Content-Length."""
    head, _, rest = bytes(record).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]]
    size = int(dict(fields)["Content-Length"])
    assert lines[0] == "WARC/1.1" and rest[size:] == b"\r\n\r\n"
    return fields, rest[:size]


def test_every_record_of_the_pages_reads_back(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = queries.op1_warc_derivatives(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        fields, block = _parsed(r["record"])
        told = dict(fields)
        assert block.decode() == r["block"] and told["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"]
        assert told["WARC-Refers-To"] == f"<{r['refers_to']}>" and told["WARC-Record-ID"] == r["record_id"] and told["WARC-Date"] == r["warc_date"]
        assert told["WARC-Target-URI"] == r["target_uri"] and told["WARC-Type"] == r["warc_type"]
        html = pages[r["page_id"]] or ""
        assert told["WARC-Source-Payload-Digest"] == warc.digest(html.encode())
        if r["warc_type"] == "metadata":
            twin = _Twin()
            twin.feed(html)
            twin.close()
            own = [x.split(": ", 1) for x in r["block"].split("\r\n")[:-1]]
            assert [v for k, v in own if k == "outlink"] == twin.outlinks and own[0] == ["title", " ".join(twin.title.split())]


def test_values_stay_on_their_line_and_ids_of_unknown_sources_differ(spark):
    rows = [("a", None, "http://x/\r\nWARC-Type: evil", None, bytearray(b"one")), ("b", None, "http://x/", None, bytearray(b"two")),
            ("c", "urn:\nx", "u", None, bytearray(b"HTTP/1.1 200 OK\r\nX: a\rb\r\n\r\n<a href='x\r\ny: z'>"))]
    got = warc.build_derivatives(spark.createDataFrame(rows, RESPONSES), derived="2026-12-01T00:00:00Z").collect()
    assert len({r["record_id"] for r in got}) == 6 and {r["warc_date"] for r in got} == {"2026-12-01T00:00:00Z"}
    for r in got:
        fields, _ = _parsed(r["record"])
        assert [v for k, v in fields if k == "WARC-Type"] == [r["warc_type"]]
        if r["warc_type"] == "metadata":
            assert all(": " in x for x in r["block"].split("\r\n")[:-1])


def test_tags_are_read_in_one_pass():
    for piece in ("<a ", "<a href=", "<title", "<title>", "<div ", "<!--", "<script>", "<a x='", "<a " + " " * 50):
        page, start = piece * (1_000_000 // len(piece)), time.time()
        warc.plain_text(page)
        warc.metadata_fields(page, {}, b"")
        assert time.time() - start < 4, piece
    assert warc.links("<a data-href='no' HREF=\"yes\"><abbr href=x><a\nhref = z/><a href>") == ["yes", "z/", ""]
