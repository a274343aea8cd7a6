"""Line formats as table functions, and decoded Windows events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caselens.sources import formats as fm
from caselens.sources import normalize as no


def block_format():
    """A class made here is sent to the workers by value; they cannot import tests."""
    class Block(fm.LineFormat):
        """Records begin with 'user <name>' and go on with 'did <what>' lines."""

        columns = "ts timestamp_ntz, subject string, action string, object string"

        def __init__(self):
            self.user, self.done = None, []

        def feed(self, line, number):
            if line.startswith("user "):
                yield from self.close()
                self.user, self.done = line[5:], []
            elif line.startswith("did "):
                self.done.append(line[4:])

        def close(self):
            if self.user is not None:
                yield {"subject": self.user, "action": "worked", "object": "+".join(self.done) or None}

    return Block


def test_records_over_lines(spark):
    Block = block_format()
    texts = {f"f{k}.blk": "\n".join(x for i in range(k) for x in (f"user u{k}.{i}", *[f"did d{j}" for j in range(i)])) for k in range(6)}
    files = spark.createDataFrame([("case", n, "blk", t) for n, t in texts.items()], "case_id string, source_file string, file_type string, content string").repartition(3)
    fm.register_format(spark, "blk", Block)
    try:
        got = {(r.case_id, r.source_file, r.subject, r.action, r.object, r.event_type, r.severity, str(r.ts)) for r in no.dispatch(files, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    finally:
        no.unregister("blk")
    want = {("case", f"f{k}.blk", f"u{k}.{i}", "worked", "+".join(f"d{j}" for j in range(i)) or None, "generic", "info", "2024-01-01 00:00:00") for k in range(6) for i in range(k)}
    assert got == want
    lines = no.text_lines(files.select("source_file", "content"))
    sql = spark.sql("SELECT b.source_file, b.subject, b.line_number FROM blk(TABLE({lines})) b WHERE b.subject LIKE 'u3%'", lines=lines)
    assert sorted(tuple(r) for r in sql.collect()) == [("f3.blk", "u3.0", 2), ("f3.blk", "u3.1", 4), ("f3.blk", "u3.2", 6)]
    with pytest.raises(Exception, match="lack line_number"):
        fm.table_function(Block)(lines.drop("line_number").asTable()).collect()
    assert fm.events_of(lines.limit(0), fm.table_function(Block)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_in_batches_give_the_rows_of_the_table_function(spark):
    """Files of equal and missing names, of other cases, longer than a batch, without lines: the same rows, handed over as Arrow."""
    Block = block_format()
    texts = [("a", "f1", 5), ("a", "f2", 0), ("b", "f1", 3), ("b", "f1", 0), (None, "f1", 2), ("a", None, 4), ("a", "f3", 40)]
    rows = [(c, n, "blk", "\n".join(x for i in range(k) for x in (f"user {c}{n}{k}.{i}", "did \x00é", "", "did y"))) for c, n, k in texts] + [("a", "f4", "blk", None)]
    files = spark.createDataFrame(rows, "case_id string, source_file string, file_type string, content string").repartition(3)
    lines = no.text_lines(files)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got, want = fm.read_lines(lines, Block), fm.table_function(Block)(lines.asTable())
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 54
        assert fm.read_lines(lines.limit(0), Block).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dispatch_takes_lines_in_batches(spark):
    """No line is handed to Python as a row of its own, and the query deals its texts by file before it gathers them."""
    from __spark_entry__ import queries

    plan = plan_of(queries()["src_windows_events"](spark, "/root/testdata/sf0.001"))
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan
    assert "REPARTITION_BY_NUM" in plan and "ObjectHashAggregate(keys=[source_file" in plan


def test_values_of_other_types(spark):
    """Values are cast to the column's type, whether lines come one by one or in batches."""
    class Odd(fm.LineFormat):
        columns = "ts timestamp_ntz, processed_at timestamp, subject string, pid bigint, confidence double, is_anomaly boolean, mitre_techniques array<string>"

        def feed(self, line, number):
            import datetime as dt
            zone = dt.timezone(dt.timedelta(hours=2))
            yield {"ts": dt.datetime(2024, 1, 1, 5, tzinfo=zone if number % 2 else None), "processed_at": dt.datetime(2024, 1, 1, 5, tzinfo=zone), "subject": number if number % 3 else line, "pid": number, "confidence": 0.5, "is_anomaly": number > 1, "mitre_techniques": [line] * (number - 1)}
            yield {}

    lines = no.text_lines(spark.createDataFrame([("f", "a\nb\nc\nd"), ("g", "x")], "source_file string, content string"))
    got, want = fm.read_lines(lines, Odd), fm.table_function(Odd)(lines.asTable())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 10


ONE = """<Event xmlns='x'><System><Provider Name="Sec"/><EventID>4688</EventID><Level>2</Level><TimeCreated SystemTime="2024-03-01T10:00:00.1234567Z"/><Channel>Security</Channel><Computer>H1</Computer></System>
<EventData><Data Name="SubjectUserName">bob</Data><Data Name='TargetUserName'>-</Data><Data Name="NewProcessName">C:\\a &lt;b&gt;.exe</Data>
<Data Name="CommandLine">a
 b</Data><Data Name="Empty"/></EventData></Event>"""


def read(*lines):
    f = fm.WindowsEvents()
    out = [e for i, x in enumerate(lines) for e in f.feed(x, i + 1)]
    return out + list(f.close())


@pytest.mark.parametrize("text", [ONE, ONE.replace("\n", ""), "noise <Eventual>\n" + ONE + "more\n" + ONE + ONE])
def test_windows_events(text):
    found = read(*text.split("\n"))
    assert len(found) == text.count("</Event>")
    for e in found:
        assert (e["ts"], e["event_type"], e["severity"], e["subject"], e["action"], e["object"], e["hostname"]) == (
            dt.datetime(2024, 3, 1, 10, 0, 0, 123456), "process_creation", "high", "bob", "event_4688", "C:\\a <b>.exe", "H1")
        assert e["command_line"].replace("\n", "") == "a b" and '"Empty": ""' in e["details"]


def test_windows_events_that_are_none(monkeypatch):
    assert read("") == read("no event") == read("<Event><System>", "never ends") == []
    bare = read("<Event></Event>")[0]
    assert (bare["subject"], bare["action"], bare["ts"], bare["object"]) == ("System", "event_unknown", None, None)
    assert read("<Event><TimeCreated SystemTime='soon'/></Event>")[0]["ts"] is None
    assert read("<Event><TimeCreated SystemTime='2024-03-01T12:00:00+02:00'/></Event>")[0]["ts"] == dt.datetime(2024, 3, 1, 10)
    monkeypatch.setattr(fm, "LONGEST_EVENT", 50)
    assert [e["action"] for e in read("<Event>" + "x" * 60, "<EventID>1</EventID></Event>", "<Event><EventID>7</EventID></Event>")] == ["event_7"]
