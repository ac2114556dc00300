import json

from pyspark.sql import functions as F

from llm import warc

HTML = "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><h1>Hi</h1><p>one <b>two</b><br>thr&eacute;e</p><!-- no --><a href='/x?a=1&amp;b=2'>go</a><table><tr><td>1</td><td>2</td></tr></table></body>"


def test_text_and_links():
    assert warc.page_text(HTML) == "A & B\nHi\none two\nthrée\ngo\n1 2"
    assert warc.page_text("") == "" and warc.page_text("a < b and c > d") == "a < b and c > d"


def test_records_link_to_their_source(spark):
    rows = [(1, "http://a/x", HTML), (2, None, None), (3, "http://b", ""), (3, "http://b", ""), (4, "u", "<p>" * 50_000 + "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("headers", F.lit("clash"))
    source = {r.record_id: r for r in warc.responses_of(pages).collect()}
    records = warc.derivatives(warc.responses_of(pages), keep=["page_id"])
    data = records.select("*", warc.serialised(F.col("headers"), F.col("block")).alias("data")).collect()
    assert len(data) == 2 * len(rows)
    for r in data:
        (headers, block), *more = warc.parsed(bytes(r.data))
        assert not more and headers == r.headers and block == bytes(r.block) and len(block) == int(headers["Content-Length"])
        response = source[r.refers_to]
        assert headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Date"] == response.headers["WARC-Date"]
        assert headers.get("WARC-Target-URI") == response.headers.get("WARC-Target-URI") and headers["WARC-Block-Digest"] == warc.digest(block)
        if r.record_type == "metadata":
            about = json.loads(block)
            _, fields, payload = warc.split_http(bytes(response.block))
            assert about["Payload-Digest"] == warc.digest(payload) and about["Source"] == response.headers and about["HTTP-Headers"] == [list(f) for f in fields]
    first = json.loads(next(r.block for r in data if r.page_id == 1 and r.record_type == "metadata"))
    assert first["Title"] == "A & B" and first["Links"] == [{"tag": "a", "url": "/x?a=1&b=2"}]
    assert next(bytes(r.block).decode() for r in data if r.page_id == 1 and r.record_type == "conversion") == warc.page_text(HTML)
    joined = b"".join(bytes(r.data) for r in data)
    assert len(warc.parsed(joined)) == len(data)
    assert warc.derivatives(warc.responses_of(pages.limit(0))).count() == 0


def test_blocks_without_a_head():
    kinds = {k: (h, b) for k, _, h, b in warc.derived(None, {}, b"\xff\xfeplain")}
    assert kinds["conversion"][1].decode() == "ÿþplain" and "WARC-Refers-To" not in kinds["conversion"][0]


def test_heads_with_line_feeds_or_without_an_end():
    status, fields, payload = warc.split_http(b"HTTP/1.1 200 OK\nContent-Type: text/html\n\n<p>hello</p>\r\n\r\nx")
    assert (status, fields, payload) == ("HTTP/1.1 200 OK", [("Content-Type", "text/html")], b"<p>hello</p>\r\n\r\nx")
    whole = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    assert warc.split_http(whole) == ("", [], whole)
    assert warc.split_http(b"HTTP/1.0 200\r\n\r\n") == ("HTTP/1.0 200", [], b"")


def test_encoded_payloads():
    import gzip
    import zlib

    page = "<p>é…</p>".encode()
    chunks = b"4\r\n" + page[:4] + b"\r\n" + f"{len(page) - 4:x};x=y\r\n".encode() + page[4:] + b"\r\n0\r\n\r\n"
    assert warc.page_of([("Transfer-Encoding", "chunked")], chunks) == page.decode()
    assert warc.page_of([("Transfer-Encoding", "chunked")], b"no chunks") == "no chunks"
    assert warc.page_of([("content-encoding", "gzip")], gzip.compress(page)) == page.decode() == warc.page_of([("Content-Encoding", "deflate")], zlib.compress(page))
    assert warc.page_of([("content-encoding", "gzip")], page) == page.decode()
    assert warc.page_of([("Content-Type", 'text/html; charset="ISO-8859-2"')], "ł".encode("iso-8859-2")) == "ł"
    assert warc.page_of([("Content-Type", "text/html; charset=none-such")], page) == page.decode()


def test_long_broken_pages_take_linear_time():
    import time

    for part in ("<a ", "<a href=", "<", "< ", "<!--", "<p ", "<script", "<script>", "</script ", "<svg><svg>", "<a href='x' ", "<title>", "&lt;", "\n "):
        began = time.process_time()
        html = part * (400_000 // len(part))
        warc.page_text(html), warc.page_links(html), warc.page_title(html)
        assert time.process_time() - began < 3, part


def plain_text(html):
    """By Python's own parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        out, skip = "", 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.out += "\n" if tag in ("p", "div", "br", "h1", "li", "ul", "title", "body", "head", "html") else " " if tag in ("td", "th") else ""

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            self.out += " " if tag in ("script", "style") else ""
            self.out += "\n" if tag in ("p", "div", "h1", "li", "ul", "title", "body", "head", "html") else " " if tag in ("td", "th") else ""

        def handle_data(self, data):
            self.out += "" if self.skip else data.replace("\n", " ")

        def handle_comment(self, data):
            self.out += " "

    parser = Plain()
    parser.feed(html)
    parser.close()
    return "\n".join(line for line in (" ".join(x.split()) for x in parser.out.split("\n")) if line)


def test_text_is_that_of_a_plain_parser():
    import random

    rng = random.Random(7)
    blocks = ["<p>", "</p>", "<div class='a'>", "</div>", "<br>", "<b>", "</b>", "<i x=1>", "</i>", "<h1>", "</h1>", "<!-- c > d -->", "<script>if (a<b) {}</script>", "<style>p{}</style>", "<td>", "</td>"]
    for _ in range(300):
        html = "".join(rng.choice([*blocks, "one ", "two", " a &amp; b ", "é ", "3 < 4 ", "\n"]) for _ in range(rng.randint(0, 60)))
        assert "\n".join(" ".join(x.split()) for x in warc.page_text(html).split("\n")) == plain_text(html), html


def test_a_page_is_scanned_once(monkeypatch):
    scans, scan = [], warc.pieces
    monkeypatch.setattr(warc, "pieces", lambda html: scans.append(html) or scan(html))
    page = "<p>a  b\t</p> \n<p> </p><td>c</td><a href=x>d</a>"
    (_, _, _, about), (_, _, _, text) = warc.derived("r", {}, page.encode())
    assert scans == [page] and text == b"a b\nc d" and b'"url": "x"' in about
