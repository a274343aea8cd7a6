import encodings.aliases
import gzip
import hashlib
import io
import os
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from caselens.llm import queries, warc
from caselens.session import materialize, scratch_path

SILENT = {"script", "style", "template", "noscript", "head", "svg", "iframe", "object", "title"}


class Reader(HTMLParser):
    """Another reading of a page: words of its text by line, links, title and language."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.silent, self.lines, self.links, self.title, self.lang = [], [""], [], None, None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in SILENT:
            self.silent.append(tag)
            if tag == "title" and self.title is None:
                self.title = ""
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang")
        if tag == "a" and attrs.get("href") is not None and not self.silent:
            self.links.append(attrs["href"])
        if tag in warc.LINES:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in SILENT and tag in self.silent:
            while self.silent.pop() != tag:
                pass
        if tag in warc.LINES:
            self.lines.append("")

    def handle_data(self, data):
        if self.silent[-1:] == ["title"]:
            self.title += data
        if not self.silent:
            self.lines[-1] += data


def records_in(folder):
    """Another reader of the files: gzip as a whole, then record after record by their lengths."""
    for file in sorted(os.listdir(folder)):
        if file.endswith(".warc.gz"):
            f = io.BytesIO(gzip.decompress(open(f"{folder}/{file}", "rb").read()))
            while line := f.readline():
                assert line == b"WARC/1.1\r\n"
                head = {}
                while (line := f.readline()) != b"\r\n":
                    k, _, v = line.decode().rstrip("\r\n").partition(": ")
                    head[k] = v
                body = f.read(int(head["Content-Length"]))
                assert f.read(4) == b"\r\n\r\n"
                yield head, body


def test_all_pages_against_other_readers(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = scratch_path(spark, "warc")
    told = materialize(warc.write_derivatives(pages, path), "files")
    found = list(records_in(path.removeprefix("file:")))
    rows = {str(r.page_id): r for r in pages.collect()}
    assert len(found) == 2 * len(rows) == told.agg({"records": "sum"}).first()[0]
    by_id = {h["WARC-Record-ID"]: h for h, _ in found}
    assert len(by_id) == len(found)
    for h, body in found:
        row = rows[h["X-Source-Key"]]
        assert by_id[h["WARC-Concurrent-To"]]["WARC-Refers-To"] == h["WARC-Refers-To"] and h["WARC-Refers-To-Target-URI"] == h["WARC-Target-URI"] == row.url
        assert h["WARC-Block-Digest"] == warc.digest(body)
        assert h["WARC-Source-Payload-Digest"] == warc.digest((row.html or "").encode())
        want = Reader(row.html or "")
        if h["WARC-Type"] == "conversion":
            assert body.decode().split("\n") == [x for x in (" ".join(line.split()) for line in want.lines) if x] or not body
            assert body.decode().split() == " ".join(want.lines).split()
        else:
            fields = [tuple(x.split(": ", 1)) for x in body.decode().split("\r\n") if x]
            assert [v for k, v in fields if k == "outlink"] == list(dict.fromkeys(x for x in (urljoin(row.url, link.strip()).partition("#")[0] for link in want.links) if x))
            assert dict(fields).get("title", "") == " ".join((want.title or "").split("\n")).strip() and dict(fields).get("language") == want.lang
    got = queries.op5(spark, sf)
    assert got.count() == len(found)
    one_pass = {(r.record_id, r.block) for r in got.select("record_id", "block").collect()}
    assert one_pass == {(r.record_id, bytes(r.block).decode()) for r in warc.derive(warc.responses(pages)).collect()}


def of(payload, *headers, target="http://s.example/d/"):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in headers) + b"\r\n" + payload
    made = warc.derivatives("<r>", target, None, {}, block)
    fields = [tuple(x.split(": ", 1)) for x in made[0]["block"].decode().split("\r\n") if x]
    return dict(fields), [v for k, v in fields if k == "outlink"], made[1]["block"].decode() if len(made) > 1 else None


@pytest.mark.parametrize("page,text", [
    ("a < b then c > d", "a < b then c > d"), ("I <3 you > me", "I <3 you > me"), ("x<y>z", "xz"), ("<p>a</ p>b<?php c ?>d<!x>e", "abde"), ("1<2 <b>and</b> 3>2", "1<2 and 3>2"),
    ("<P>A<DiV title='a > b'>B</dIv>C", "A\nB\nC"), ("a&#10;b&lt;i&gt;<br>c\x1ed", "a b<i>\nc d")])
def test_what_is_a_tag(page, text):
    assert warc.plain_text(page) == text


@pytest.mark.parametrize("page,title,lang", [
    ("<!-- <title>old</title> --><title>new</title>", "new", None), ("<titlebar>x</titlebar><title>t</title>", "t", None), ('<script>"<title>s</title>"</script><html data-lang="xx" lang="de"><title>t</title>', "t", "de"),
    ('<html xml:lang="fr-CH">', None, "fr-ch"), ("<html hreflang=en>", None, None), ("<title>open", None, None), ("<title>a</title><svg><title>b</title></svg>", "a", None), ("<title></title><p>", "", None)])
def test_title_and_language(page, title, lang):
    fields, _, _ = of(page.encode(), "Content-Type: text/html")
    assert (fields.get("title"), fields.get("language")) == (title or (None if title is None else ""), lang)


def test_base_address():
    _, links, _ = of(b"<base href='/b/'><a href=x>1</a><a data-href=no href='y'>2</a>", "Content-Type: text/html")
    assert links == ["http://s.example/b/x", "http://s.example/b/y"]


def chunked(data, n):
    return b"".join(b"%x\r\n%s\r\n" % (len(data[i : i + n]), data[i : i + n]) for i in range(0, len(data), n)) + b"0\r\n\r\n"


def test_packed_payloads():
    page = ("<p>" + "été " * 500).encode()
    raw = zlib.compressobj(wbits=-15)
    for payload, headers in [
            (gzip.compress(page), ["Content-Encoding: gzip"]), (zlib.compress(page), ["Content-Encoding: deflate"]), (raw.compress(page) + raw.flush(), ["Content-Encoding: Deflate"]),
            (chunked(page, 7), ["Transfer-Encoding: chunked"]), (chunked(gzip.compress(page), 100), ["Transfer-Encoding: chunked", "Content-Encoding: x-gzip"]), (page, ["Transfer-Encoding: chunked"]),
            (page, ["Content-Encoding: identity"])]:
        fields, _, text = of(payload, "Content-Type: text/html; charset=utf-8", *headers)
        assert text == " ".join(["été"] * 500) and "unread-payload" not in fields
    for payload, coding in [(page, "br"), (b"broken", "gzip"), (gzip.compress(page)[:-9], "gzip")]:
        fields, links, text = of(payload, "Content-Type: text/html", f"Content-Encoding: {coding}")
        assert text is None and not links and fields["unread-payload"].startswith("coding")


def test_payloads_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(warc, "PAYLOAD_BYTES", 1000)
    assert of(gzip.compress(b"x" * 1000), "Content-Type: text/plain", "Content-Encoding: gzip")[2] == "x" * 1000
    assert of(gzip.compress(b"x" * 1100), "Content-Type: text/plain", "Content-Encoding: gzip")[2] is None


def test_binary_types_have_no_conversion():
    for kind, yes in [("image/png", False), ("application/pdf", False), ("application/octet-stream", False), ("application/json", True), ("application/xhtml+xml", True), ("text/csv; charset=x", True), ("", True)]:
        made = warc.derivatives("<r>", None, None, {}, b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\n\r\nabc")
        assert len(made) == 1 + yes and made[0]["concurrent_to"] == (made[1]["record_id"] if yes else None)


def test_every_charset_name():
    for charset in {*encodings.aliases.aliases, *encodings.aliases.aliases.values(), "undefined", "idna", "punycode", "unicode_escape", "mbcs", "no-such"}:
        _, _, text = of(b"<p>abc", f"Content-Type: text/html; charset={charset}")
        assert text is not None


def test_cut_files_are_named(spark, tmp_path):
    r = {"record_type": "conversion", "record_id": "<a>", "refers_to": "<b>", "concurrent_to": None, "target_uri": "u", "date": "d", "content_type": "text/plain", "block_digest": "x", "headers": {}, "block": b"hi"}
    whole = gzip.compress(warc.serialized(r))
    for n, ok in ((len(whole), True), (len(whole) - 5, False), (3, False)):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "k.warc.gz").write_bytes(whole + whole[:n])
        if ok:
            assert warc.read(spark, str(folder)).count() == 2
        else:
            with pytest.raises(Exception, match="k.warc.gz"):
                warc.read(spark, str(folder)).collect()


def test_two_runs_leave_the_same_files(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sums = []
    for _ in range(2):
        path = scratch_path(spark, "warc")
        warc.write_derivatives(pages, path).collect()
        sums.append({f: hashlib.sha256(open(f"{path.removeprefix('file:')}/{f}", "rb").read()).hexdigest() for f in os.listdir(path.removeprefix("file:")) if not f.startswith(".")})
    assert sums[0] == sums[1] and sums[0]
