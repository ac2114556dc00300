"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records that are linked to it: a metadata record (JSON: status,
HTTP headers, title, links, digests, sizes) and a conversion record (the text of the page). Both
carry the response's target URI and date and refer to its record id; all header
fields of the source that describe the capture are kept in the metadata. Their own ids
are derived from the source's, so a repeated task writes the same records.

Records are made where responses are read: no shuffle. ``serialised`` gives the bytes of each
record as a WARC file has them; files are concatenations of these, and ``parsed`` reads
them back.

Defined results: a null block counts as empty and gives a record with empty text; a block
without a whole HTTP head is all payload; a payload is read in its head's charset, else as UTF-8, else as Latin-1; chunked and
compressed payloads are undone for the text, and kept as they are if that fails; null header fields are left out. Equal responses give equal records. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORDS = "record_type string, record_id string, refers_to string, headers map<string,string>, block binary"
#: Elements whose content isn't text, elements that begin a line, and cells.
_DROPPED = frozenset("script style noscript template svg".split())
_BREAKS = frozenset("p div br hr li ul ol dl dt dd table tr h1 h2 h3 h4 h5 h6 section article header footer nav aside main title blockquote pre form body head html".split())
_CELLS = frozenset("td th option".split())
_LINKED = frozenset("a link img script iframe".split())
_NAME = re.compile(r"<\s*(/?)\s*([a-z][a-z0-9-]*)", re.I)
_TARGET = re.compile(r"\b(?:href|src)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _DROPPED}
_TITLE_END = re.compile(r"</title", re.I)
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S \n]")  # a single space stays as it is


def pieces(html: str):
    """The texts and tags of a page in order, by one scan: ("text", text), or (name, raw tag, whether it opens, where it ends).

    Comments and the content of scripts and the like are left out. A tag ends at the next ``>``; a ``<`` that no name, ``/``, ``!`` or ``?`` follows,
    or no ``>`` at all, is text. Each character is looked at a bounded number of times, whatever the page.
    """
    at = since = 0
    last = html.rfind(">")
    while (at := html.find("<", at)) >= 0 and at < last:
        if html.startswith("<!--", at):
            yield "text", html[since:at]
            yield "text", " "
            end = html.find("-->", at + 4)
            at = since = len(html) if end < 0 else end + 3
            continue
        named = _NAME.match(html, at)
        name = named[2].lower() if named else ""
        tight = html[at + 1 : at + 2]
        if not (name in _BREAKS or name in _CELLS or tight.isascii() and tight.isalpha() or tight in ("/", "!", "?")):
            at += 1
            continue
        end = html.find(">", at) + 1
        yield "text", html[since:at]
        opens = named is not None and not named[1]
        yield name, html[at:end], opens, end
        at = since = end
        if opens and name in _DROPPED and tight not in ("", " "):
            yield "text", " "
            closed = _ENDS[name].search(html, end)
            at = since = closed.end() if closed else len(html)
    yield "text", html[since:]


def page_text(html: str, scanned: list | None = None) -> str:
    """The readable text of a page, a line for each block. ``scanned``: the page's ``pieces``, if they are known."""
    from html import unescape

    out = []
    for part in pieces(html) if scanned is None else scanned:
        kind = part[0]
        if kind == "text":
            piece = part[1]
            out.append(piece.replace("\r", " ").replace("\n", " ") if "\n" in piece or "\r" in piece else piece)
        elif kind in _BREAKS:
            out.append("\n")
        elif kind in _CELLS:
            out.append(" ")
    lines = (line.strip(" ") for line in _BLANKS.sub(" ", unescape("".join(out))).split("\n"))
    return "\n".join(line for line in lines if line)


def page_title(html: str, scanned: list | None = None) -> str | None:
    for part in pieces(html) if scanned is None else scanned:
        if part[0] == "title" and part[2]:
            end = _TITLE_END.search(html, part[3])
            return page_text(html[part[3] : end.start()]) if end else None
    return None


def page_links(html: str, scanned: list | None = None) -> list[dict[str, str]]:
    """Tag and URL of every link, in order."""
    from html import unescape

    out = []
    for part in pieces(html) if scanned is None else scanned:
        if part[0] in _LINKED and part[2] and (found := _TARGET.search(part[1])):
            out.append({"tag": part[0], "url": unescape(found[1].strip("\"'"))})
    return out


def digest(data: bytes) -> str:
    import base64
    import hashlib

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP response; lines may end in LF only. Without a whole head all is payload."""
    end = _HEAD_END.search(block) if block.startswith(b"HTTP/") else None
    if end is None:
        return "", [], block
    lines = re.split(r"\r?\n", block[: end.start()].decode("latin-1"))
    return lines[0], [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line], block[end.end() :]


def unchunked(data: bytes) -> bytes:
    """The body in chunked data; what isn't chunked as said stays as it is."""
    out, at = [], 0
    while True:
        end = data.find(b"\n", at, at + 1_000)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return data
        n, at = int(size, 16), end + 1
        if not n:
            return b"".join(out)
        if at + n > len(data):
            return data
        out.append(data[at : at + n])
        at += n
        at += 2 if data.startswith(b"\r\n", at) else 1


def page_of(fields: list[tuple[str, str]], payload: bytes) -> str:
    """The page in a payload: chunks joined, gzip or deflate undone, read in the charset that the head names, else UTF-8, else Latin-1."""
    import zlib

    named = {k.lower(): v for k, v in fields}
    if "chunked" in named.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    if named.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompress(payload, 47)  # either header
        except zlib.error:
            pass
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""), re.I)
    for name in (charset[1] if charset else "utf-8", "utf-8"):
        try:
            return payload.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return payload.decode("latin-1")


def derived(record_id: str | None, headers: dict[str, str], block: bytes) -> list[tuple[str, str, dict[str, str], bytes]]:
    """(type, id, header fields, block) of the metadata and the conversion record."""
    import json
    import uuid

    status, fields, payload = split_http(block)
    html = page_of(fields, payload)
    scanned = list(pieces(html))  # once for all three
    text = page_text(html, scanned).encode("utf-8", "replace")
    about = {
        "Source": headers, "HTTP-Status": status, "HTTP-Headers": fields, "Title": page_title(html, scanned),
        "Links": page_links(html, scanned),
        "Payload-Digest": digest(payload), "Payload-Length": len(payload), "Text-Digest": digest(text), "Text-Length": len(text),
    }
    out = []
    for kind, data, media in (("metadata", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"), "application/json"), ("conversion", text, "text/plain")):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"
        kept = {k: headers[k] for k in ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID") if headers.get(k) is not None}
        named = {"WARC-Type": kind, "WARC-Record-ID": own, **kept, "Content-Type": media, "Content-Length": str(len(data)), "WARC-Block-Digest": digest(data)}
        if record_id is not None:
            named["WARC-Refers-To"] = record_id
        out.append((kind, own, named, data))
    return out


def derivatives(responses: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Two records for each of ``responses`` (record_id, headers, block); the columns ``keep`` go with them."""
    keep = list(keep)
    kept = [responses[c].alias(f"_k{i}") for i, c in enumerate(keep)]

    def run(batches):
        import pyarrow as pa

        from llm.tokens import in_batches

        for batch in batches:
            for a, b in in_batches(batch.column(2)):
                part = batch.slice(a, b - a)
                rows, at = [], []
                for i, (record_id, headers, block) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                    for record in derived(record_id, {k: v for k, v in dict(headers or []).items() if v is not None}, block or b""):
                        rows.append((record[0], record[1], record_id, list(record[2].items()), record[3]))
                        at.append(i)
                types = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
                made = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*made, *[part.column(3 + c).take(pa.array(at, pa.int32())) for c in range(len(keep))]], names=names)

    names = ["record_type", "record_id", "refers_to", "headers", "block", *[f"_k{i}" for i in range(len(keep))]]
    schema = ", ".join([RECORDS, *[f"_k{i} {responses.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]])
    out = responses.select("record_id", "headers", "block", *kept).mapInArrow(run, schema)
    return out.select("record_type", "record_id", "refers_to", "headers", "block", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def serialised(headers: Column, block: Column) -> Column:
    """The bytes of a record in a WARC file; the fields in the order of their names."""
    fields = F.array_sort(F.map_entries(headers))
    lines = F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\r\n")
    head = F.concat(F.lit("WARC/1.1\r\n"), lines, F.lit("\r\n\r\n")).cast("binary")
    return F.concat(head, block, F.lit("\r\n\r\n").cast("binary"))


def parsed(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records (header fields, block) in the bytes of a WARC file."""
    out, at = [], 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        start, size = end + 4, int(headers["Content-Length"])
        out.append((headers, data[start : start + size]))
        at = start + size + 4
    return out


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of raw pages, with ids from page and URL: page_id, record_id, headers, block."""
    html = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    key = F.md5(F.concat_ws("\x1f", pages[id_col].cast("string"), pages[url_col]).cast("binary"))
    uuid = F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 4), F.substring(key, 13, 4), F.substring(key, 17, 4), F.substring(key, 21, 12))
    record_id = F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    headers = F.map_filter(
        F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), record_id, F.lit("WARC-Target-URI"), pages[url_col], F.lit("WARC-Date"), F.lit(date), F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
        lambda k, v: v.isNotNull(),
    )
    return pages.select(pages[id_col].alias("page_id"), record_id.alias("record_id"), headers.alias("headers"), F.concat(head.cast("binary"), html).alias("block"))
