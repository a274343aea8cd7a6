"""Golden micro-fixtures of the normalisers."""

import json
import datetime as dt

from pyspark.sql import functions as F

from caselens.operators.entities import entity_rows, relation_rows
from caselens.sources import manifest as mf
from caselens.sources import normalize as no
from caselens.schema import conform


def ts0():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def test_csv_aliases(spark):
    df = spark.createDataFrame(
        [("192.168.1.5", "8.8.8.8", "50000", "443", "jdoe", "5420", "powershell -enc x", "2024-01-02T03:04:05Z")],
        "src_ip string, dst_ip string, src_port string, dst_port string, user string, pid string, cmdline string, time string")
    r = no.csv(df, "a.csv", ts0()).first()
    assert (r.source, r.source_ip, r.destination_ip, r.destination_port, r.username, r.pid) == (
        "csv", "192.168.1.5", "8.8.8.8", 443, "jdoe", 5420)
    assert r.ts == dt.datetime(2024, 1, 2, 3, 4, 5) and r.hostname is None
    assert r.object == "8.8.8.8"  # no object column: second column
    kinds = {e.type for e in entity_rows(no.csv(df, "a.csv", ts0())).collect()}
    assert {"User", "IPAddress", "Port"} <= kinds


def test_csv_header_in_any_case_and_compat(spark):
    df = spark.createDataFrame([("x", None, "HIGH")], "Thing string, Other string, Severity string")
    r = no.csv(df, "f.csv", ts0(), compat=True).first()
    assert (r.severity, r.subject, r.object, r.action, r.hostname) == ("high", "x", None, "occurred", "CSVHost")


def test_ndjson(spark):
    df = spark.createDataFrame([(
        '{"timestamp": "2024-01-01T00:00:00Z", "event_type": "process_creation", "username": "bob", "process_name": "cmd.exe", "ip": "1.2.3.4"}\n'
        'garbage\n{"broken": \n'
        '{"timestamp": "2024-01-01T00:00:05Z", "event_type": "network_connection", "src_ip": "10.0.0.1", "dst_ip": "9.9.9.9"}',)], "content string")
    a, b = no.json(no.json_items(df), "x.json", ts0()).orderBy("ts").collect()
    assert (a.username, a.process_name, a.host_ip, a.event_type) == ("bob", "cmd.exe", "1.2.3.4", "process_creation")
    assert (b.destination_ip, b.source_ip, b.username) == ("9.9.9.9", "10.0.0.1", "System")


def test_json_array_and_single_object(spark):
    df = spark.createDataFrame([('[{"subject": "a", "user": {"username": "u1", "domain": "D"}}, {"subject": "b"}]',), ('{"subject": "c"}',)], "content string")
    rows = {r.subject: r for r in no.json(no.json_items(df), "x", ts0()).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].username, rows["a"].user_domain, rows["b"].username) == ("u1", "D", "b")


def test_hash_manifest(spark):
    md5, sha = "d41d8cd98f00b204e9800998ecf8427e", "e" * 64
    df = spark.createDataFrame([(f"{md5.upper()}  evil.exe",), (f"{sha} *tool.bin",), ("# note",), ("not a hash",)], "line string")
    rows = {r.subject: r for r in no.hashes(df, "m.md5", ts0()).collect()}
    assert set(rows) == {"evil.exe", "tool.bin"}
    assert rows["evil.exe"].file_md5 == md5 and rows["tool.bin"].file_sha256 == sha
    assert {r.severity for r in rows.values()} == {"info"}


def test_text_line_windows_path_wins(spark):
    line = r"Error: download from http://evil.example/x.exe by 10.1.2.3 saved to C:\Users\bob\x.exe"
    df = spark.createDataFrame([("# skip",), ("",), (line,)], "content string")
    r = no.text(no.text_lines(df), "log.txt", ts0()).first()
    assert (r.severity, r.source_ip, r.url, r.file_path) == ("medium", "10.1.2.3", "http://evil.example/x.exe", r"C:\Users\bob\x.exe")
    c = no.text(no.text_lines(df), "log.txt", ts0(), compat=True).first()
    assert c.file_path.startswith("//evil.example") and c.hostname == "LogHost"


def test_chrome_epoch_and_join(spark):
    urls = spark.createDataFrame([(1, "http://a.onion/x", "T", 3)], "id long, url string, title string, visit_count long")
    visits = spark.createDataFrame([(1, 13350000000000000), (2, 1)], "url long, visit_time long")
    r = no.chrome(visits, urls, ts0()).collect()
    assert len(r) == 1 and r[0].severity == "high" and r[0].mitre_techniques == ["T1090.003"]
    assert r[0].ts == dt.datetime(1601, 1, 1) + dt.timedelta(microseconds=13350000000000000)


def test_packets(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "10.0.0.1", "5.6.7.8", 6, 64, 100, 1234, 4444, "S", "a.b.", None, None)],
        "ts timestamp_ntz, src_ip string, dst_ip string, proto int, ttl int, length long, sport long, dport long, flags string, dns_query string, http_host string, http_path string")
    r = no.packets(df).first()
    assert (r.action, r.object, r.severity, r.direction, r.domain, r.mitre_techniques) == (
        "sent_tcp_packet", "5.6.7.8:4444", "medium", "outbound", "a.b", ["T1043"])


def test_custom_format_can_be_registered(spark):
    no.register("pipe", lambda files, ts: conform(files.select(
        F.lit("generic").alias("event_type"), F.split("content", r"\|")[0].alias("subject"), "source_file")))
    try:
        files = spark.createDataFrame([("pipe", "a.pipe", "x|y")], "file_type string, source_file string, content string")
        assert [r.subject for r in no.dispatch(files, ts0()).collect()] == ["x"]
    finally:
        no._TEXT_TYPES.pop("pipe")


def test_windows_event_row(spark):
    xml = ("<Event><System><Provider Name='Microsoft-Windows-Security-Auditing'/><EventID>4688</EventID>"
           "<Computer> PC1 </Computer></System></Event>")
    r = spark.createDataFrame([(xml,)], "x string").selectExpr(
        "cast(xpath_string(x, '/Event/System/EventID') as int) as id", "trim(xpath_string(x, '/Event/System/Computer')) as pc").first()
    assert (r.id, r.pc) == (4688, "PC1")


def test_entities_and_provenance(spark):
    df = conform(spark.createDataFrame(
        [("e1", "c1", "v1", "H", "bob", "CORP", "cmd.exe", 7, "winword.exe", 3, "8.8.8.8", 443, "f.log")],
        "event_id string, case_id string, evidence_id string, hostname string, username string, user_domain string, process_name string, pid long, "
        "parent_process_name string, parent_pid long, destination_ip string, destination_port long, source_file string"))
    assert {r.type for r in entity_rows(df).collect()} == {"Host", "User", "Process", "IPAddress", "Port"}
    rel = {r.rel_type: r for r in relation_rows(df).collect()}
    assert {"EXECUTED", "SPAWNED", "CONNECTED_TO", "USES_PORT", "OCCURRED_ON"} == set(rel)
    assert (rel["SPAWNED"].source, rel["SPAWNED"].target) == ("H:3:winword.exe", "H:7:cmd.exe")
    assert all((r.case_id, r.evidence_id, r.event_id, r.source_file) == ("c1", "v1", "e1", "f.log") for r in rel.values())


def test_manifest_from_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes.fromhex("d4c3b2a1") + b"xx")
    (tmp_path / "b.csv").write_bytes(b"h\n1\n")
    df = mf.read_files(spark, str(tmp_path)).select(F.lit("o").alias("organization_id"), F.lit("c").alias("case_id"), "filename", "content")
    rows = {r.filename: r for r in mf.manifest(df).collect()}
    assert rows["a.bin"].file_type == "pcap" and rows["a.bin"].size_bytes == 6
    assert rows["b.csv"].object_name == f"o/c/{rows['b.csv'].sha256}.csv"


def test_csv_text_of_any_shape(spark, tmp_path):
    """Empty headers keep their place, 200 columns stay, quotes may hold commas, quotes and line breaks; both readers agree."""
    wide = [f"h{i}" for i in range(200)]
    files = {
        "gap.csv": "subject,,action\nalice,x,login\n",
        "wide.csv": ",".join(["subject", *wide, "action"]) + "\n" + ",".join(["bob", *wide, "last"]) + "\n",
        "quoted.csv": 'Subject,object,action\r\n"carol","a, ""b""\nsecond line",open\r\n\r\ndave,,"""q"""\r\n',
        "one.csv": "action\nonly\n",
    }
    rows = []
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
        ev = no.csv(no.read_csv(spark, str(tmp_path / name)), name, ts0())
        rows += [(r.subject, r.action, r.object, r.details, r.source_file) for r in ev.select("subject", "action", "object", "details", "source_file").collect()]
    whole = spark.createDataFrame([("csv", n, t) for n, t in files.items()], "file_type string, source_file string, content string")
    got = [(r.subject, r.action, r.object, r.details, r.source_file) for r in no.dispatch(whole, ts0()).select("subject", "action", "object", "details", "source_file").collect()]
    assert sorted(got) == sorted(rows) and len(rows) == 5
    by = {r[0]: r for r in rows}
    assert by["alice"][1] == "login" and by["bob"][1] == "last" and len(json.loads(by["bob"][3])) == 202
    assert by["carol"][2] == 'a, "b"\nsecond line' and by["dave"][1] == '"q"'
