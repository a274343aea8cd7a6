"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Each response gives one ``metadata`` record (application/warc-fields: title,
language, links, and every header of the source) and one ``conversion`` record
(text/plain). Both name the response in WARC-Refers-To, keep its target, date and
digests, and name each other in WARC-Concurrent-To. Record identifiers follow
from the source's identifier, so a task that runs twice makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm.common import byte_slices, folder, open_store, publish

DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 20
PAYLOAD_BYTES = 256 << 20  # a compressed payload that grows beyond is kept packed
LEVEL = 4  # of gzip: 6 takes a quarter more time for files 0.7 % smaller
RECORD = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, block_digest string, headers map<string,string>, block binary"
RECORD_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "binary": pa.binary()}.get(c.split()[1], pa.map_(pa.string(), pa.string()))) for c in RECORD.replace("<string,string>", "").split(", ")])

# Elements that begin a new line, and elements that hold no text.
LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())

# A head without an end tag ends before anything that cannot stand in it.
DROP = re.compile(r"<(?:!--|(script|style|template|noscript|head|svg|iframe|object|title)(?=[\s>/])[^>]*>)", re.I)
END = {k: re.compile(rf"</{k}\s*>", re.I) for k in "script style template noscript head svg iframe object title".split()} | {"": re.compile("-->")}
IN_HEAD = re.compile(r"\s+|<(?:!--|/head\s*>|/?(script|style|title|noscript|template)(?=[\s>/])[^>]*>|/?(?:meta|link|base|basefont|bgsound|head|html)(?=[\s>/])[^>]*>|![^>]*>)", re.I)
# A tag begins with a letter (after a slash, if it ends an element); declarations and what else begins with <! <? </ run to the next >.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+'|["'])*+>|<[!?/][^>]*+>""")
LINE_END = "\x1e"
HREF = re.compile(r"""<a\s[^>]*?(?<=\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
BASE = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
LANG = re.compile(r"""\s(?:xml:)?lang\s*=\s*["']?([A-Za-z-]+)""", re.I)
OPENING = re.compile(r"<(?:!--|(script|style|html|title|base)(?=[\s>/])([^>]*)>)", re.I)
META = re.compile(rb"<(?:!--|(script|style)(?=[\s>/])[^>]*>|meta(?=[\s/])([^<>]*)>)", re.I)
END_BYTES = {b"": re.compile(b"-->"), b"script": re.compile(rb"</script\s*>", re.I), b"style": re.compile(rb"</style\s*>", re.I)}
CHUNK = re.compile(rb"([0-9a-fA-F]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n")
CHARSET = re.compile(rb"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def one_line(value: str) -> str:
    return (re.sub(r"[\r\n]+\s*", " ", value) if "\n" in value or "\r" in value else value).strip()


def visible(page: str) -> str:
    """The page without comments and silent elements, in one pass.

    Scripts, styles and comments without an end reach to the end of the page, a
    head to its end tag or to what cannot stand in it. Other silent elements go
    up to their end tag; without one, or closed by themselves as an svg may be,
    only their tag goes.
    """
    out, at, gone = [], 0, set()
    while m := DROP.search(page, at):
        out.append(page[at : m.start()])
        kind = (m.group(1) or "").lower()
        if kind == "head":
            at = _head_end(page, m.end(), gone)
        else:
            at = m.end() if kind == "svg" and m.group().endswith("/>") else _closed(page, m.end(), kind, gone)
    return " ".join([*out, page[at:]])


def _closed(page: str, at: int, kind: str, gone: set[str]) -> int:
    """Where the element ends whose tag ends at ``at``; gone: kinds without another end tag, so that none is looked for twice."""
    end = None if kind in gone else END[kind].search(page, at - 2 if not kind else at)  # <!--> is a whole comment
    if end:
        return end.end()
    gone.add(kind)
    return len(page) if kind in ("", "script", "style") else at


def _head_end(page: str, at: int, gone: set[str]) -> int:
    while m := IN_HEAD.match(page, at):
        at, tag = m.end(), m.group().lower()
        if tag.startswith("</head"):
            break
        if tag == "<!--" or m.group(1) and tag[1] != "/":
            at = _closed(page, at, (m.group(1) or "").lower(), gone)
    return at


def plain_text(page: str) -> str:
    """Visible text, a line per block element; white space within a line is one space."""
    return _lines(visible(page))


class _Separators(dict):
    """What stands for a tag in the text: a line end for block elements, nothing for others."""

    def __missing__(self, name: str | None) -> str:
        mark = LINE_END if name and name.lower() in LINES else ""
        if len(self) < 10_000:
            self[name] = mark
        return mark


_separators = _Separators()


def _lines(page: str) -> str:
    parts = TAG.split(page.replace(LINE_END, " "))
    parts[1::2] = map(_separators.__getitem__, parts[1::2])
    lines = (" ".join(x.split()) for x in html.unescape("".join(parts)).split(LINE_END))
    return "\n".join(filter(None, lines))


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; bytes without a head are all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in rest) if c], payload


def _meta_charset(payload: bytes) -> re.Match | None:
    """The first charset of a meta tag, wherever it stands outside comments, scripts and styles."""
    at = 0
    while m := META.search(payload, at):
        at = m.end()
        if m.group(2) is not None:
            if found := CHARSET.search(m.group(2)):
                return found
        elif end := END_BYTES[(m.group(1) or b"").lower()].search(payload, at - 2 if not m.group(1) else at):
            at = end.end()
        else:
            return None
    return None


def _value(m: re.Match) -> str:
    return html.unescape(next(g for g in m.groups() if g is not None)).strip()


def head_marks(page: str) -> tuple[str | None, str | None, str | None]:
    """Title, language and base address: of the first title, html tag with a language and base tag outside comments, scripts and styles."""
    title = lang = base = None
    at, titles = 0, True
    while m := OPENING.search(page, at):
        at, kind = m.end(), (m.group(1) or "").lower()
        if kind == "html":
            if lang is None and (found := LANG.search(m.group(2))):
                lang = found.group(1).lower()
        elif kind == "base":
            if base is None and (found := BASE.search(m.group(2))):
                base = _value(found)
        elif kind == "title":
            if titles and (end := END[kind].search(page, at)):
                title = page[at : end.start()] if title is None else title
                at = end.end()
            else:
                titles = False  # no end tag from here on
        elif end := END[kind].search(page, at - 2 if not kind else at):
            at = end.end()
        else:
            break
    return title, lang, base


def language_of(page: str) -> str | None:
    return head_marks(page)[1]


def unpacked(http: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """The payload without chunks and compression, and what kept it from being unpacked.

    A payload that names chunks but has none is taken as it is. More than
    ``PAYLOAD_BYTES``, other codings and broken data stay packed.
    """
    names = {k.lower(): v.lower() for k, v in http}
    if "chunked" in names.get("transfer-encoding", ""):
        payload = _joined(payload)
    for coding in reversed([c.strip() for c in names.get("content-encoding", "").split(",") if c.strip() not in ("", "identity")]):
        if coding not in ("gzip", "x-gzip", "deflate"):
            return payload, f"coding {coding}"
        for bits in (47, -15) if coding == "deflate" else (47,):
            z = zlib.decompressobj(bits)
            try:
                out = z.decompress(payload, PAYLOAD_BYTES)
            except zlib.error:
                continue
            if z.eof:
                payload = out
                break
        else:
            return payload, f"coding {coding}, broken or too long"
    return payload, None


def _joined(payload: bytes) -> bytes:
    """The contents of the chunks; the payload itself if it does not consist of chunks."""
    out, at = [], 0
    while m := CHUNK.match(payload, at):
        size = int(m.group(1), 16)
        if not size:
            return b"".join(out)
        out.append(payload[m.end() : m.end() + size])
        at = m.end() + size + 2
    return payload


def is_text(content_type: str) -> bool:
    kind = content_type.partition(";")[0].strip().lower()
    return not kind or kind.startswith("text/") or any(x in kind for x in ("html", "xml", "json", "javascript"))


def decoded(payload: bytes, content_type: str) -> tuple[str, str]:
    found = CHARSET.search(content_type.encode("latin-1", "replace")) or _meta_charset(payload)
    charset = found.group(1).decode().lower() if found else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except (LookupError, UnicodeError):  # no such charset, or one that is none for texts
        return payload.decode("utf-8", "replace"), "utf-8"


def outlinks(page: str, base: str) -> Iterator[str]:
    """Addresses that the page's links name, without their fragments."""
    try:
        parts = urlsplit(base)
        origin = f"{parts.scheme}://{parts.netloc}" if parts.netloc else ""
    except ValueError:
        base = origin = ""
    for m in HREF.finditer(page):
        href = html.unescape(next(g for g in m.groups() if g is not None)).strip()
        try:
            plain = origin and href[:1] == "/" and href[1:2] != "/" and "/." not in href  # what urljoin would do, for most links
            yield one_line(origin + href if plain else urljoin(base, href)).partition("#")[0]
        except ValueError:
            continue


def derivatives(record_id: str, target_uri: str | None, date: str | None, headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response; a payload that is no text, or cannot be unpacked, has no conversion."""
    status, http, payload = http_parts(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html")
    plain, packed = unpacked(http, payload)
    readable = packed is None and is_text(kind)
    page, charset = decoded(plain, kind) if readable else ("", None)
    is_html = readable and "html" in kind.lower()
    title, lang, base = head_marks(page) if is_html else (None, None, None)
    seen = visible(page) if is_html else page
    links = dict.fromkeys(outlinks(seen, _against(target_uri or "", base))) if is_html else {}
    text = (_lines(seen) if is_html else page).encode("utf-8", "replace")
    source = {k: v for k, v in headers.items() if v is not None}
    payload_digest = source.get("WARC-Payload-Digest") or digest(payload)
    block_digest = source.get("WARC-Block-Digest") or digest(block)
    fields = [("charset", charset), ("title", one_line(html.unescape(title)) if title is not None else None), ("language", lang), ("status", status or None), ("unread-payload", packed),
              *[(f"http-{k.lower()}", v) for k, v in http], *[(f"source-{k}", v) for k, v in sorted(source.items())], ("text-length", str(len(text)) if readable else None), *[("outlink", x) for x in links if x]]
    meta = "".join([f"{k}: {one_line(v)}\r\n" for k, v in fields if v is not None]).encode("utf-8", "replace")
    ids = {t: name(record_id, t) for t in (("metadata", "conversion") if readable else ("metadata",))}
    kept = {"WARC-Refers-To-Target-URI": target_uri, "WARC-Refers-To-Date": date, "WARC-Source-Payload-Digest": payload_digest, "WARC-Source-Block-Digest": block_digest,
            **{k: v for k, v in source.items() if k.startswith("X-") or k in ("WARC-Warcinfo-ID", "WARC-IP-Address", "WARC-Identified-Payload-Type")}}
    marks = [(k, one_line(v)) for k, v in kept.items() if v is not None]
    out = []
    for t, other, content, body in (("metadata", "conversion", "application/warc-fields", meta), ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        if t in ids:
            out.append({"record_type": t, "record_id": ids[t], "refers_to": record_id, "concurrent_to": ids.get(other), "target_uri": target_uri, "date": date, "content_type": content,
                        "block_digest": digest(body), "headers": marks, "block": body})
    return out


def _against(target: str, base: str | None) -> str:
    if not base:
        return target
    try:
        return urljoin(target, base)
    except ValueError:
        return target


def _response(key: str | None, url: str | None, page: str | None, date: str) -> dict:
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    uri = re.sub(r"[\s<>]", lambda m: f"%{ord(m.group()):02X}", url) if url is not None else None
    marks = {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "X-Source-Key": key}
    return {"record_type": "response", "record_id": name("response", str(key), str(url), marks["WARC-Payload-Digest"]), "refers_to": None, "concurrent_to": None, "target_uri": uri, "date": date,
            "content_type": "application/http; msgtype=response", "block_digest": marks["WARC-Block-Digest"], "headers": [(k, v) for k, v in marks.items() if v is not None], "block": block}


def _pages(pages: DataFrame, key_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(pages[key_col].cast("string").alias("key"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))


def responses(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages, their key kept in the header X-Source-Key.

    A null page is an empty one, a null address is left out; the identifier comes
    from key, address and content, so rows that are equal in all are one record twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "html"):
                yield pa.RecordBatch.from_pylist([_response(*row, date) for row in zip(*(c.to_pylist() for c in part.columns))], schema=RECORD_SCHEMA)

    return _pages(pages, key_col, url_col, html_col).mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; records of other types give none.

    A response without text has an empty conversion record; repeated responses
    give repeated records; an empty table gives none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "block"):
                made = [d for r in part.to_pylist() for d in derivatives(r["record_id"], r["target_uri"], r["date"], dict(r["headers"] or []), r["block"] or b"")]
                yield pa.RecordBatch.from_pylist(made, schema=RECORD_SCHEMA)

    kept = records.filter("record_type = 'response' and record_id is not null")
    return kept.select("record_id", "target_uri", "date", "headers", "block").mapInArrow(run, RECORD)


HEADERS = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
           ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"))


def serialized(r: dict) -> bytes:
    lines = [(k, r[c]) for k, c in HEADERS if r[c] is not None] + [x for x in dict(r["headers"] or []).items() if x[0] not in dict(HEADERS) and x[0] != "Content-Length"]
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in [*lines, ("Content-Length", str(len(r["block"] or b"")))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + (r["block"] or b"") + b"\r\n\r\n"


def _files(records: Iterator[dict], path: str) -> Iterator[pa.RecordBatch]:
    """Writes records to this task's files and tells each finished one."""
    store, root = open_store(path)
    store.create_dir(root)
    task, attempt, no = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
    sink, n, size = None, 0, 0
    final = hidden = ""

    def close() -> pa.RecordBatch:
        sink.close()
        publish(store, hidden, f"{root}/{final}")
        return pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], ["file", "records"])

    for r in records:
        if sink is None:
            final = f"part-{task:07d}-{no:05d}.warc.gz"
            hidden = f"{root}/.{final}.{attempt}"
            sink, n, size, no = store.open_output_stream(hidden, compression=None), 0, 0, no + 1
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(serialized(r)) + z.flush()
        sink.write(member)
        n, size = n + 1, size + len(member)
        if size >= FILE_BYTES:
            yield close()
            sink = None
    if sink is not None:
        yield close()


def write(records: DataFrame, path: str) -> DataFrame:
    """Write each task's records to .warc.gz files, a gzip member per record; lazily returns (file, records). Evaluate once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _files((r for batch in batches for part in byte_slices(batch, "block") for r in part.to_pylist()), path)

    return records.select(*RECORD_SCHEMA.names).mapInArrow(run, "file string, records long")


def write_derivatives(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """``write(derive(responses(pages)), path)`` in one pass over the pages: no record leaves its task but in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in byte_slices(batch, "html") for row in zip(*(c.to_pylist() for c in part.columns)))
        made = (_response(*row, date) for row in rows)
        yield from _files((d for r in made for d in derivatives(r["record_id"], r["target_uri"], r["date"], dict(r["headers"]), r["block"])), path)

    return _pages(pages, key_col, url_col, html_col).mapInArrow(run, "file string, records long")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Contents of the gzip members in a stream; ``EOFError`` if the stream ends inside one."""
    z, out, open_ = zlib.decompressobj(31), [], False
    for data in chunks:
        while data:
            out.append(z.decompress(data))
            data, open_ = z.unused_data, True
            if z.eof:
                yield b"".join(out)
                z, out, open_ = zlib.decompressobj(31), [], False
    if open_:
        raise EOFError("a gzip member is cut off")


def parsed(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    lines = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if c]
    got = {k.lower(): v for k, v in lines}
    known = {k for k, _ in HEADERS} | {"Content-Length"}
    return {**{c: got.get(k.lower()) for k, c in HEADERS}, "headers": [x for x in dict(lines).items() if x[0] not in known], "block": body[: int(got.get("content-length", len(body)))]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all .warc.gz files in a folder; a folder without files gives none.

    A file is a task, as gzip cannot be entered midway; ``write`` begins a new
    one at FILE_BYTES. A file that is cut off or broken ends the read with its name.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder(path))
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{file}", compression=None) as f:
                    rows, size, done = [], 0, 0
                    try:
                        for record in members(iter(lambda: f.read(READ_BYTES), b"")):
                            rows.append(parsed(record))
                            size, done = size + len(record), done + 1
                            if size >= 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)
                                rows, size = [], 0
                    except (EOFError, zlib.error) as e:
                        raise ValueError(f"{root}/{file}: {e}, after record {done}") from e
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)

    return names.repartition(max(1, spark.sparkContext.defaultParallelism), "file").mapInArrow(run, RECORD)
