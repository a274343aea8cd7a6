"""Formats of log lines as Python table functions: from DataFrames, through ``dispatch`` and laterally in SQL."""

from __future__ import annotations

import datetime as dt
import html
import re
from collections.abc import Callable, Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, UserDefinedTableFunction

from caselens.schema import conform
from caselens.sources import normalize as no

IDS = ("case_id", "evidence_id", "organization_id")


class LineFormat:
    """A format whose records are made of one or more lines. One object reads one file."""

    columns = "ts timestamp_ntz, subject string, action string, object string"  # what its events hold, named like canonical columns

    def feed(self, line: str, number: int) -> Iterator[dict]:
        """Takes the next line; gives the events that it completes."""
        raise NotImplementedError

    def close(self) -> Iterator[dict]:
        """Gives what is left when the file ends."""
        return iter(())


def table_function(make: Callable[[], LineFormat]) -> UserDefinedTableFunction:
    """A table function over a table with source_file, line and line_number; ids of the scope are passed on.

    It asks for the lines file by file and in order, so that a record may span
    lines: a file is one task, which holds a line at a time and what the format keeps.
    """
    given = T.StructType.fromDDL(make().columns)

    class Lines:
        def __init__(self) -> None:
            self.format, self.last = make(), None

        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            if not lines.isTable:
                raise ValueError("a table of lines is needed: format(TABLE(lines))")
            known = {f.name: f for f in lines.dataType.fields}
            if missing := {"source_file", "line", "line_number"} - set(known):
                raise ValueError(f"the lines lack {', '.join(sorted(missing))}")
            kept = [known[c] for c in IDS if c in known]
            return AnalyzeResult(
                schema=T.StructType([*kept, known["source_file"], T.StructField("line_number", T.LongType()), *given.fields]),
                partitionBy=[PartitioningColumn(c) for c in (*(f.name for f in kept), "source_file")], orderBy=[OrderingColumn("line_number")])

        def _rows(self, events: Iterator[dict]) -> Iterator[tuple]:
            for e in events:
                yield (*[self.last[c] for c in IDS if c in self.last], self.last["source_file"], self.last["line_number"], *[e.get(f.name) for f in given.fields])

        def eval(self, lines: Row) -> Iterator[tuple]:
            self.last = lines
            if lines["line"] is not None:
                yield from self._rows(self.format.feed(lines["line"], lines["line_number"]))

        def terminate(self) -> Iterator[tuple]:
            if self.last is not None:
                yield from self._rows(self.format.close())

    return F.udtf(Lines)


def _array(values: list, kind: T.DataType) -> pa.Array:
    """Values of events as Arrow; Spark casts them to the column's type. What mixes types is text."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return pa.array([None if x is None else kind.toInternal(x) for x in values], pa.int64())
    try:
        return pa.array(values)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return pa.array([None if x is None else str(x) for x in values], pa.string())


def read_lines(lines: DataFrame, make: Callable[[], LineFormat]) -> DataFrame:
    """The rows that ``table_function`` gives, for lines whose columns are known: they come and go as Arrow batches.

    A file is still one task that takes its lines in order; only the rows are not
    handed to Python and back one by one.
    """
    given = T.StructType.fromDDL(make().columns)
    kept = [*[c for c in IDS if c in lines.columns], "source_file"]
    schema = T.StructType([*[lines.schema[c] for c in kept], T.StructField("line_number", T.LongType()), *given.fields])

    class Lines:
        def __init__(self) -> None:
            self.format, self.last = make(), None

        def _batch(self, events: list[tuple[int, dict]]) -> pa.RecordBatch:
            columns = [pa.repeat(x, len(events)) for x in self.last[:-1]]
            columns += [pa.array([n for n, _ in events], pa.int64()), *[_array([e.get(f.name) for _, e in events], f.dataType) for f in given.fields]]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        def eval(self, lines: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            numbers, events = lines.column("line_number").to_pylist(), []
            for line, n in zip(lines.column("line").to_pylist(), numbers):
                if line is not None:
                    events += [(n, e) for e in self.format.feed(line, n)]
            self.last = [*[lines.column(c)[0] for c in kept], numbers[-1]]
            if events:
                yield self._batch(events)

        def terminate(self) -> Iterator[pa.RecordBatch]:
            if self.last is not None and (events := [(self.last[-1], e) for e in self.format.close()]):
                yield self._batch(events)

    table = lines.select(*kept, "line", F.col("line_number").cast("bigint").alias("line_number")).asTable()
    return F.arrow_udtf(Lines, returnType=schema)(table.partitionBy(*kept).orderBy("line_number"))


def register_format(spark: SparkSession, name: str, make: Callable[[], LineFormat], source: str = "text") -> None:
    """Makes a format known: as SQL table function ``name`` and as file type ``name`` of ``dispatch``."""
    spark.udtf.register(name, table_function(make))
    no.register(name, lambda files, ts: _events(read_lines(no.text_lines(files), make), ts, source))


def events_of(lines: DataFrame, function: UserDefinedTableFunction, default_ts: Column | None = None, source: str = "text") -> DataFrame:
    """Canonical events of lines (source_file, line, line_number, ids)."""
    return _events(function(lines.asTable()), default_ts, source)


def _events(rows: DataFrame, default_ts: Column | None, source: str) -> DataFrame:
    filled = rows.withColumn("source", F.lit(source)).withColumn("mitre_techniques", F.array().cast("array<string>")) if "mitre_techniques" not in rows.columns else rows.withColumn("source", F.lit(source))
    for column, value in (("event_type", "generic"), ("severity", "info"), ("action", "occurred")):
        filled = filled.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in filled.columns else F.lit(value))
    if "ts" in filled.columns and default_ts is not None:
        filled = filled.withColumn("ts", F.coalesce("ts", default_ts))
    return conform(filled)


# ---- Windows events as XML --------------------------------------------------------------

XML_FIELD = re.compile(
    r"<(?:(EventID|Channel|Computer|Level)\b[^>]*>([^<]*)<|TimeCreated\b[^>]*?SystemTime\s*=\s*[\"']([^\"']*)|Provider\b[^>]*?\bName\s*=\s*[\"']([^\"']*)"
    r"|Security\b[^>]*?UserID\s*=\s*[\"']([^\"']*)|Data\b[^>]*?\bName\s*=\s*[\"']([^\"']*)[\"'][^>]*?(?:/>|>([^<]*)<))")
XML_LEVELS = {"1": "critical", "2": "high", "3": "medium"}  # fixed values: levels of the event schema
LONGEST_EVENT = 4 << 20  # characters; what goes on without an end is no event


class WindowsEvents(LineFormat):
    """Decoded Windows events: <Event> elements, one or many a line or over lines, with anything between them.

    One pass over each element takes its fields; nothing is built of it. An
    element without an end, or one longer than ``LONGEST_EVENT``, is no event.
    """

    columns = ("ts timestamp_ntz, event_type string, severity string, subject string, action string, object string, hostname string, username string, user_domain string, "
               "process_name string, command_line string, parent_process_name string, source_ip string, service_name string, registry_key string, details string")
    # Names of event data that fill canonical columns, first match wins.
    DATA = {"username": ["TargetUserName", "SubjectUserName", "User"], "user_domain": ["TargetDomainName", "SubjectDomainName"], "process_name": ["NewProcessName", "Image", "ProcessName"],
            "command_line": ["CommandLine"], "parent_process_name": ["ParentProcessName", "ParentImage"], "source_ip": ["IpAddress", "SourceIp"], "service_name": ["ServiceName"],
            "registry_key": ["TargetObject", "ObjectName"]}
    TYPES = {"4688": "process_creation", "1": "process_creation", "3": "network_connection", "4624": "auth_event", "4625": "auth_event", "4634": "auth_event", "4648": "auth_event", "13": "registry_change", "4657": "registry_change", "11": "file_modification", "4663": "file_modification"}

    def __init__(self) -> None:
        self.held: list[str] = []
        self.size = 0

    def feed(self, line: str, number: int) -> Iterator[dict]:
        at = 0
        while True:
            if not self.held:
                start = _EVENT.search(line, at)
                if start is None:
                    return
                at = start.start()
            end = line.find("</Event>", at)
            if end < 0:
                self.held.append(line[at:])
                self.size += len(line) - at
                if self.size > LONGEST_EVENT:
                    self.held, self.size = [], 0
                return
            text = "\n".join([*self.held, line[at:end]])
            self.held, self.size, at = [], 0, end + 8
            yield self._event(text)

    def _event(self, text: str) -> dict:
        system, data = {}, {}
        for m in XML_FIELD.finditer(text):
            kind = m.lastindex
            value = m[kind]
            if kind >= 6:  # a name alone has no content
                name, value = m[6], value if kind == 7 else ""
                if name not in data:
                    data[name] = (html.unescape(value) if "&" in value else value).strip()
            elif kind == 2:
                if m[1] not in system:
                    system[m[1]] = (html.unescape(value) if "&" in value else value).strip()
            elif (key := _ATTRIBUTES[kind]) not in system:
                system[key] = html.unescape(value)
        out = dict.fromkeys(self.DATA)
        for c, names in self.DATA.items():
            for n in names:
                if n in data and data[n] not in ("", "-"):
                    out[c] = data[n]
                    break
        code = system.get("EventID") or "unknown"
        return out | {
            "ts": _time(system.get("TimeCreated")), "event_type": self.TYPES.get(code, "generic"), "severity": XML_LEVELS.get(system.get("Level", ""), "info"), "hostname": system.get("Computer"),
            "subject": out["username"] or system.get("UserID") or system.get("Computer") or "System", "action": f"event_{code}",
            "object": out["process_name"] or out["registry_key"] or out["service_name"] or system.get("Channel") or system.get("Provider"),
            "details": f'{{"data": {_object(data)}, "system": {_object(system)}}}'}


_EVENT = re.compile(r"<Event(?=[\s>])")
_ATTRIBUTES = {3: "TimeCreated", 4: "Provider", 5: "UserID"}  # groups of XML_FIELD
_MICROS = re.compile(r"(\.\d{6})\d+")


def _object(texts: dict[str, str]) -> str:
    """Texts by name as JSON, ordered by name."""
    return "{" + ", ".join([f"{encode_basestring(n)}: {encode_basestring(texts[n])}" for n in sorted(texts)]) + "}"


def _time(text: str | None) -> dt.datetime | None:
    """A time of the schema, in UTC, to microseconds; None for what is none."""
    try:
        found = dt.datetime.fromisoformat(_MICROS.sub(r"\1", (text or "").strip()))
    except ValueError:
        return None
    return (found if found.tzinfo is dt.timezone.utc else found.astimezone(dt.timezone.utc)).replace(tzinfo=None) if found.tzinfo else found


def register_windows_events(spark: SparkSession) -> None:
    """File type and SQL table function ``windows_events``."""
    register_format(spark, "windows_events", WindowsEvents, "evtx")
