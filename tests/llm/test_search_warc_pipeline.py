import base64
import gzip
import hashlib
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from caselens.llm import topk, warc
from caselens.llm.queries import QUERIES
from caselens.session import materialize, scratch_path


def brute_top(rows, queries, k):
    out = []
    for q, a in queries:
        found = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows if v != q))[:k]
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block,asked,k", [(7, 3, 4), (2048, 512, 10), (5, 1, 200)])
def test_top_k(spark, block, asked, k):
    r = random.Random(block)
    rows = [(i, [r.choice([0, 0, 1, -2, 3, 900]) for _ in range(r.choice([5, 5, 8, 0]))]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, q array<long>").repartition(3)
    got = topk.top_k(df, df.filter("vec_id % 10 = 0"), k, block, asked)
    assert sorted(tuple(x) for x in got.collect()) == brute_top(rows, rows[::10], k)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [0.0009, 1.0]), (6, [])]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: r.q for r in v.collect()} == {0: [512, -256], 5: [0, 1024], 6: []}
    assert topk.top_k(v.filter("vec_id < 0"), v.filter("vec_id < 0")).count() == 0
    assert topk.top_k(v, v.filter("vec_id < 0")).count() == 0
    one = v.filter("vec_id = 0")
    assert topk.top_k(one, one).count() == 0


def test_every_query_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names)


# --- WARC

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><a href="/x?a=1&amp;b=2#top">one</a> <a href='http://o.example/'>two</a></nav><!-- no <p>text</p> --><p>Été <b>vif</b> &lt;tag&gt;<br>next
line</p><div title="a > b">end</div><script>open"""


def test_text_and_links():
    assert warc.plain_text(PAGE) == "one two\nÉté vif <tag>\nnext line\nend"
    meta, text = warc.derivatives("<urn:uuid:1>", "http://s.example/d/", "2020-01-01T00:00:00Z", {"WARC-IP-Address": "10.0.0.1"}, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: x\r\n\r\n" + PAGE.encode())
    fields = meta["block"].decode().split("\r\n")
    assert {"title: A & B", "language: fr", "http-server: x", "source-WARC-IP-Address: 10.0.0.1", "outlink: http://s.example/x?a=1&b=2", "outlink: http://o.example/"} <= set(fields)
    assert meta["refers_to"] == text["refers_to"] == "<urn:uuid:1>" and meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    assert dict(text["headers"])["WARC-Source-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()


def test_other_payloads():
    _, text = warc.derivatives("<r>", None, None, {}, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\n\xe9 <b>")
    assert text["block"].decode() == "é <b>"
    _, text = warc.derivatives("<r>", "x:y", None, {}, b"")
    assert text["block"] == b""
    _, text = warc.derivatives("<r>", None, None, {}, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n<p>a")
    assert text["block"] == b"a"
    assert warc.plain_text("<" * 50000 + 'a href="' * 2000) is not None


def test_files_round_trip(spark):
    rows = [(1, "http://a.example/\r\nX: y", "<p>one"), (2, None, None), (None, "http://b.example/", ""), (3, "http://c.example/", "<p>" + "long " * 100_000), (3, "http://c.example/", "<p>" + "long " * 100_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, block string, headers string")
    records = materialize(warc.derive(warc.responses(pages)), "records")
    path = scratch_path(spark, "warc")
    files = materialize(warc.write(records, path), "files")
    assert files.agg({"records": "sum"}).first()[0] == 10
    key = lambda r: (r.record_id, r.record_type, r.refers_to, r.concurrent_to, r.target_uri, r.date, r.content_type, r.block_digest, tuple(sorted(r.headers.items())), bytes(r.block))
    back = warc.read(spark, path).collect()
    assert sorted(map(repr, map(key, back))) == sorted(map(repr, map(key, records.collect())))
    for r in back:
        assert r.block_digest == warc.digest(bytes(r.block))
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_plain_gzip_reads_the_file(spark, tmp_path):
    record = warc.serialized({"record_type": "conversion", "record_id": "<a>", "refers_to": "<b>", "concurrent_to": None, "target_uri": "u", "date": "d", "content_type": "text/plain", "block_digest": "x", "headers": {"Content-Length": "7", "K": "v"}, "block": b"hi\r\n\r\n!"})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    got = warc.read(spark, str(tmp_path)).collect()
    assert len(got) == 2 and bytes(got[0].block) == b"hi\r\n\r\n!" and got[0].headers == {"K": "v"}


# --- pipeline

def test_stages(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "pii", "source_mix", "best_fit_packing"]
    for table in (docs, edge):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, materialize(stage(spark, now, sf), name)
            if name != names[-1]:
                assert now.columns == table.columns
            if name == "pii":
                assert now.count() == before.count()
        assert now.agg({"length": "max"}).first()[0] <= 1024
    left = materialize(corpus_pipeline.language(spark, docs, sf), "x")
    assert left.count() == docs.count()  # all of them hold words of their language




@pytest.mark.parametrize("page,text,links", [
    ("<html><head><title>t</title><body><p>hello <a href=/x>l</a>", "hello l", 1), ("<p>a<svg/><p>hello <a href=/x>l</a>", "a\nhello l", 1), ("<head><title>t</title>hello <a href=/x>l</a>", "hello l", 1),
    ('<head><script>"</head><p>"</script><meta charset=x><div>hi', "hi", 0), ("<p>a<svg viewBox='0'><g/><title>q</title></svg>b<noscript>c</noscript>d<iframe src=x>e<object>f", "a b d e f", 0),
    ("<p>a<script>x<p>y", "a", 0), ("<p>a<!-- x<p>y", "a", 0), ("<p>a<!--><p>b", "a\nb", 0), ("<head></head><header>k</header>", "k", 0)])
def test_open_elements(page, text, links):
    assert warc.plain_text(page) == text
    meta, conversion = warc.derivatives("<r>", "http://s.example/", None, {}, page.encode())
    assert conversion["block"].decode() == text and meta["block"].decode().count("outlink: http://s.example/x") == links


def test_many_open_elements_take_one_pass():
    for kind in ("svg", "noscript", "title", "head", "iframe"):
        assert warc.plain_text(f"<{kind}>" * 100_000 + "end") == "end"


@pytest.mark.parametrize("before", ["<!-- " + "long " * 2000 + "<html lang=xx><meta charset=utf-16> -->", " " * 9000, "<script>" + "var a;" * 2000 + "</script>", ""])
def test_late_language_and_charset(before):
    page = before + '<html class="a" lang="fr"><head><meta name=x><meta charset="iso-8859-1"></head><p>\xe9t\xe9'
    meta, text = warc.derivatives("<r>", None, None, {}, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page.encode("latin-1"))
    assert {"language: fr", "charset: iso-8859-1"} <= set(meta["block"].decode().split("\r\n"))
    assert text["block"].decode().endswith("été")
