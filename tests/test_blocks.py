"""Files in blocks: quoted CSV cut anywhere, and digests of files read in pieces."""

import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from caselens.sources import blocks as bl
from caselens.sources import manifest as mf
from caselens.sources import normalize as no


@pytest.fixture
def blocks_of(spark):
    """Sets how many bytes a block has."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def random_csv(seed, rows, ends="\n"):
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(['a', 'é', '"', ",", "\n", "\r\n", " ", "bc"]) for _ in range(r.randint(0, 12)))
    data = [["id", "note, of", "x\ny"]] + [[str(i), cell(), cell() if r.random() < 0.9 else "z" * 150 + "\n" * 90] for i in range(rows)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=ends).writerows(data)
    return out.getvalue()


@pytest.mark.parametrize("size,ends", [(64, "\n"), (333, "\r\n"), (10_000_000, "\n")])
def test_records_do_not_depend_on_blocks(spark, tmp_path, blocks_of, size, ends):
    (tmp_path / "in").mkdir()
    texts = {f"f{k}.csv": random_csv(k, 40, ends) for k in range(2)}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text, newline="")
    want = sorted(str(tuple(c or None for c in row)) for t in texts.values() for row in list(csv.reader(io.StringIO(t, newline="")))[1:])
    assert len(want) == 80
    blocks_of(size)
    if size == 64:
        assert bl.lines_of(spark, str(tmp_path / "in")).select("file", "block").distinct().count() > 40
    got = no.read_csv(spark, str(tmp_path / "in"))
    assert got.columns == ["id", "note, of", "x\ny"] and sorted(str(tuple(r)) for r in got.collect()) == want
    records = bl.csv_blocks(spark, str(tmp_path / "in")).collect()
    for name, text in texts.items():
        mine = [r.record for r in sorted((r for r in records if r.source_file == name), key=lambda r: (r.block, r.no))]
        assert "".join(x.rstrip("\r") + "\n" for x in mine) == "".join(x + "\n" for x in records_of(text))
        assert sum(r.header for r in records if r.source_file == name) == 1


def records_of(text):
    out, held, inside = [], "", False
    for c in text:
        if c == '"':
            inside = not inside
        if c == "\n" and not inside:
            out.append(held.rstrip("\r"))
            held = ""
        else:
            held += c
    return out + ([held] if held else [])


@pytest.mark.parametrize("size", [16, 1000])
def test_odd_quotes_and_open_ends(spark, tmp_path, blocks_of, size):
    (tmp_path / "in").mkdir()
    text = 'a,b\n5" disk,1\n\n"x"y"z,2\n"tail, never\nclosed\n\n3,"4'
    (tmp_path / "in" / "f.csv").write_text(text)
    (tmp_path / "in" / "empty.csv").write_text("")
    one = spark.createDataFrame([(text,)], "content string").select(F.explode(no.csv_records(F.col("content"))).alias("r"))
    blocks_of(size)
    got = sorted(((r.block, r.no), r.record) for r in bl.csv_blocks(spark, str(tmp_path / "in")).filter("record <> ''").collect())
    assert [x for _, x in got] == [r.r for r in one.collect()]


def test_each_file_has_its_header(spark, tmp_path, blocks_of):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('\n"Actor",Action\nu1,"x\ny"\nu2,go\n')
    (tmp_path / "in" / "b.csv").write_text("Action,Actor\n" + "".join(f"act{i},w{i}\n" for i in range(200)))
    blocks_of(128)
    rows = no.read_csv_records(spark, str(tmp_path / "in"))
    ev = no.csv_lines(rows, F.col("header"), F.col("line"), F.col("source_file"))
    got = {(r.subject, r.action, r.source_file) for r in ev.collect()}
    assert got == {("u1", "x\ny", "a.csv"), ("u2", "go", "a.csv")} | {(f"w{i}", f"act{i}", "b.csv") for i in range(200)}


@pytest.mark.parametrize("limit", [1, 40, 1 << 30])
def test_manifest_of_files_in_blocks(spark, tmp_path, blocks_of, limit):
    (tmp_path / "in").mkdir()
    r = random.Random(limit)
    files = {"a.txt": b"one\ntwo", "b.log": b"one\ntwo\n", "c.csv": b"\xef\xbb\xbfa,b\n1,2\n", "d.json": b"\xef\xbb\xbf[1]", "e.bin": bytes(r.randrange(256) for _ in range(5000)), "f.pcap": b"\xd4\xc3\xb2\xa1" + bytes(100), "g.md5": b"\n\n\n", "h.txt": b"x"}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    blocks_of(64)
    got = {r.filename: r for r in mf.manifest_of(spark, str(tmp_path / "in"), F.lit("o"), F.lit("c"), limit).collect()}
    assert set(got) == set(files)
    for name, data in files.items():
        m = got[name]
        assert (m.size_bytes, m.sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert m.object_name == f"o/c/{m.sha256}.{m.extension}"
    assert got["f.pcap"].file_type == "pcap" and got["c.csv"].file_type == "csv"


def test_files_of_any_size_give_the_same_events(spark, tmp_path, blocks_of):
    (tmp_path / "in").mkdir()
    files = {"a.csv": 'Actor,Action,Note\nu1,go,"x\ny"\n' + "".join(f'v{i},"a,{i}",\n' for i in range(50)), "b.log": "failed login from 10.0.0.1\n# no\n\nok line\n" * 20, "c.json": "".join(f'{{"actor": "j{i}", "action": "do"}}\n' for i in range(30)),
             "d.md5": "d41d8cd98f00b204e9800998ecf8427e  x.bin\nnothing\n" * 9}
    for name, data in files.items():
        (tmp_path / "in" / name).write_text(data)
    blocks_of(200)
    key = lambda df: sorted(map(str, df.select("source_file", "source", "event_type", "subject", "action", "object", "severity").collect()))
    ts = F.lit("2024-01-01").cast("timestamp_ntz")
    whole, cut = (key(no.dispatch_path(spark, str(tmp_path / "in"), ts, limit)) for limit in (1 << 30, 100))
    assert cut == whole and len(whole) == 51 + 40 + 30 + 9
