"""Raw evidence to canonical events.

Every normaliser takes a DataFrame (read with ``spark.read``) and returns the
canonical columns. A missing value is NULL; ``compat=True`` fills the constant
host names which some formats carry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.mitre import tag_text
from caselens.functions.network import direction, is_risky_port, url_severity
from caselens.functions.text import (
    HASH_LINE, LINE_BREAK, enum_guard, first_hash, first_ip, first_path, first_url, first_user, hash_kind, int_guard, strip,
)
from caselens.functions.when import from_chrome_micros, from_firefox_micros, parse_ts
from caselens.operators.joins import visits_with_urls
from caselens.schema import EVENT_TYPES, SEVERITIES, blank_to_null, conform, first_filled
from caselens.sources.blocks import csv_blocks
from caselens.sources.manifest import HASH_EXTENSIONS, extension, file_type, files_below

# Accepted CSV headers per logical column, first match wins.
CSV_ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date", "created"],
    "event_type": ["event_type", "type", "category", "event"],
    "subject": ["subject", "actor", "user", "username", "source_name"],
    "action": ["action", "operation", "event_id"],
    "object": ["object", "target", "path", "destination"],
    "severity": ["severity", "level", "priority"],
    "src_ip": ["src_ip", "source_ip", "source ip", "client_ip"],
    "dst_ip": ["dst_ip", "destination_ip", "destination ip", "dest_ip"],
    "src_port": ["src_port", "source_port", "source port"],
    "dst_port": ["dst_port", "destination_port", "destination port"],
    "pid": ["pid", "process_id", "process id"],
    "ppid": ["ppid", "parent_process_id", "parent process id"],
    "process_name": ["process", "process_name", "process name", "exe"],
    "cmd_line": ["command_line", "cmdline", "command line"],
    "filepath": ["file_path", "filepath", "path", "filename"],
}
JSON_FIELDS = [
    "timestamp", "time", "datetime", "subject", "actor", "user", "username", "action", "operation", "object",
    "target", "path", "severity", "level", "event_type", "type", "mitre_techniques", "techniques", "process",
    "network", "host", "hostname", "ip", "domain", "pid", "ppid", "process_name", "cmdline", "sha256", "parent_process",
    "filename", "filepath", "md5", "sha1", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "url",
    "registry_key", "service_name",
]
# A cell is quoted (with doubled quotes inside) or runs to the next comma or line end; both loops keep what they took, so the work stays linear.
CSV_CELL = r'(?:"(?:[^"]++|"")*+"?)?'
CSV_RECORD = rf'{CSV_CELL}[^,\r\n]*+(?:,{CSV_CELL}[^,\r\n]*+)*+'


def csv_records(content: Column) -> Column:
    """Records of a CSV text, blank lines left out; a line break within quotes belongs to its record."""
    return F.filter(F.regexp_extract_all(content, F.lit(CSV_RECORD), F.lit(0)), lambda r: r != "")


def csv_cells(record: Column) -> Column:
    """Cells of one record, as many as there are: an empty one is null, an empty quoted one is empty."""
    def value(cell: Column) -> Column:
        text = F.substring(cell, 2, 1 << 30)  # without the comma before it
        inner = F.replace(F.regexp_extract(text, r'(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))
        return F.when(F.length(text) == 0, F.lit(None).cast("string")).when(text.startswith('"') & text.endswith('"') & (F.length(text) > 1), inner).otherwise(text)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf',{CSV_CELL}[^,]*+'), F.lit(0)), value)


def _default_ts(default_ts: Column | None) -> Column:
    return F.current_timestamp().cast("timestamp_ntz") if default_ts is None else default_ts


def _file(source_file: Column | str | None, fallback: str) -> Column:
    if source_file is None:
        return F.lit(fallback)
    return F.lit(source_file) if isinstance(source_file, str) else source_file


def _csv_events(
    df: DataFrame, get: Callable[[list[str]], Column | None], first: Column, second: Column | None, details: Column,
    file: Column, default_ts: Column | None, compat: bool,
) -> DataFrame:
    c = {k: get(a) for k, a in CSV_ALIASES.items()}
    none = F.lit(None).cast("string")

    def col(k: str) -> Column:
        return none if c[k] is None else c[k]

    subject = first_filled(col("subject"), first, F.lit("UnknownSubject"))
    obj = first_filled(col("object"), second if second is not None else file)
    return conform(df.select(
        *[x for x in ("case_id", "evidence_id", "organization_id") if x in df.columns],
        parse_ts(col("timestamp"), _default_ts(default_ts)).alias("ts"),
        enum_guard(first_filled(col("event_type"), F.lit("generic")), EVENT_TYPES, "generic").alias("event_type"),
        enum_guard(first_filled(col("severity"), F.lit("info")), SEVERITIES, "info").alias("severity"),
        F.lit("csv").alias("source"), subject.alias("subject"), first_filled(col("action"), F.lit("occurred")).alias("action"),
        obj.alias("object"), F.lit("CSVHost" if compat else None).alias("hostname"), blank_to_null(col("src_ip")).alias("host_ip"),
        subject.alias("username"), int_guard(col("pid")).alias("pid"), int_guard(col("ppid")).alias("ppid"),
        int_guard(col("ppid")).alias("parent_pid"), blank_to_null(col("process_name")).alias("process_name"),
        blank_to_null(col("filepath")).alias("process_path"), blank_to_null(col("filepath")).alias("file_path"),
        blank_to_null(col("filepath")).alias("file_name"), blank_to_null(col("cmd_line")).alias("command_line"),
        blank_to_null(col("src_ip")).alias("source_ip"), blank_to_null(col("dst_ip")).alias("destination_ip"),
        int_guard(col("src_port")).alias("source_port"), int_guard(col("dst_port")).alias("destination_port"),
        F.lit("TCP").alias("protocol"), details.alias("details"), F.array().cast("array<string>").alias("mitre_techniques"),
        file.alias("source_file"), F.lit(0.9).alias("confidence"), F.lit("csv_alias_map").alias("extraction_method"),
    ))


def csv(df: DataFrame, source_file: Column | str | None = None, default_ts: Column | None = None, compat: bool = False) -> DataFrame:
    """A CSV read with a header: all columns are text. Aliases are resolved on the header."""
    names = [c for c in df.columns if c not in ("case_id", "evidence_id", "organization_id")]
    by_lower: dict[str, str] = {}
    for n in names:
        by_lower.setdefault(n.lower(), n)
    raw = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)],
                    *[c for c in df.columns if c not in names])
    pos = {n: f"c{i}" for i, n in enumerate(names)}

    def get(aliases: list[str]) -> Column | None:
        return next((F.col(pos[by_lower[a]]) for a in aliases if a in by_lower), None)

    second = F.col("c1") if len(names) > 1 else None
    details = F.to_json(F.struct(*[F.col(pos[n]).alias(n) for i, n in enumerate(names) if n != f"_c{i}"]))  # Spark's name for no name
    return _csv_events(raw, get, F.col("c0"), second, details, _file(source_file, "csv_file"), default_ts, compat)


def csv_lines(df: DataFrame, header: Column, line: Column, source_file: Column, default_ts: Column | None = None, compat: bool = False) -> DataFrame:
    """CSV records of many files, each with its own header record, of any width.

    A column without a header keeps its place but has no name. Of two columns with
    the same name the first counts.
    """
    rows = df.withColumn("_n", csv_cells(header)).withColumn("_h", F.transform("_n", lambda x: F.lower(F.coalesce(x, F.lit(""))))).withColumn("_v", csv_cells(line))
    cell = lambda h: F.get("_v", (F.array_position("_h", h) - 1).cast("int"))
    names = F.filter(F.array_distinct("_h"), lambda h: h != "")
    rows = rows.withColumn("_m", F.map_from_entries(F.transform(names, lambda h: F.struct(h, cell(h)))))
    shown = F.filter(F.transform(names, lambda h: F.struct(F.get("_n", (F.array_position("_h", h) - 1).cast("int")), cell(h).alias("v"))), lambda x: x["v"].isNotNull())

    def get(aliases: list[str]) -> Column:
        # the first alias that is in the header, even when its cell is empty
        name = F.get(F.filter(F.array(*[F.lit(a) for a in aliases]), lambda a: F.array_contains("_h", a)), 0)
        return F.try_element_at("_m", name)

    second = F.when(F.size("_h") > 1, F.get("_v", 1)).otherwise(source_file)
    return _csv_events(rows, get, F.get("_v", 0), second, F.to_json(F.map_from_entries(shown)), source_file, default_ts, compat)


def json_items(df: DataFrame, content: str = "content") -> DataFrame:
    """Whole JSON files to one ``item`` per row: an array, one object, or lines (bad lines are skipped).

    Text in braces is lines when its first line is an object of its own.
    """
    text = strip(F.col(content))
    is_array = text.startswith("[") & text.endswith("]")
    lines = F.split(text, LINE_BREAK)
    head = F.trim(F.get(lines, 0))
    first_is_object = (F.size(lines) > 1) & head.endswith("}") & F.try_parse_json(head).isNotNull()
    one = text.startswith("{") & text.endswith("}") & ~first_is_object
    items = (
        F.when(is_array, F.from_json(text, "array<string>")).when(one, F.array(text))
        .otherwise(F.filter(lines, lambda x: F.trim(x).startswith("{")))
    )
    rest = [c for c in df.columns if c != content]
    return df.select(*rest, F.explode(items).alias("item"))


def json(df: DataFrame, source_file: Column | str | None = None, default_ts: Column | None = None, item: str = "item") -> DataFrame:
    """One JSON object per row. A nested field wins over its flat alias."""
    schema = ", ".join(f"{k} string" for k in JSON_FIELDS) + ", _bad string"
    parsed = df.withColumn("_j", F.from_json(item, schema, {"columnNameOfCorruptRecord": "_bad"}))
    parsed = parsed.filter(F.col("_j._bad").isNull() & F.trim(item).startswith("{"))

    def j(k: str) -> Column:
        return blank_to_null(F.col("_j")[k])

    def nested(k: str, fields: str) -> Column:
        return F.from_json(F.when(F.trim(F.col("_j")[k]).startswith("{"), F.col("_j")[k]), ", ".join(f"{x} string" for x in fields.split()))

    parsed = (
        parsed.withColumn("_p", nested("process", "pid ppid name path command_line hash"))
        .withColumn("_n", nested("network", "source_ip source_port destination_ip destination_port protocol domain dns_query url direction"))
        .withColumn("_u", nested("user", "username domain sid")).withColumn("_ho", nested("host", "hostname ip os"))
    )

    def n(s: str, k: str) -> Column:
        return blank_to_null(F.col(s)[k])

    file = _file(source_file, "json_file")
    flat_user = F.when(F.col("_u").isNull(), j("user"))
    subject = F.coalesce(j("subject"), j("actor"), j("user"), j("username"), F.lit("System"))
    person = F.coalesce(n("_u", "username"), j("username"), j("subject"), j("actor"), flat_user, F.when(j("user").isNull(), F.lit("System")))
    mitre = F.coalesce(j("mitre_techniques"), j("techniques"))
    techniques = F.coalesce(F.from_json(F.when(mitre.startswith("["), mitre), "array<string>"), F.array().cast("array<string>"))
    big = "bigint"
    return conform(parsed.select(
        *[c for c in ("case_id", "evidence_id", "organization_id") if c in df.columns],
        parse_ts(F.coalesce(j("timestamp"), j("time"), j("datetime")), _default_ts(default_ts)).alias("ts"),
        enum_guard(F.coalesce(j("event_type"), j("type"), F.lit("generic")), EVENT_TYPES, "generic").alias("event_type"),
        enum_guard(F.coalesce(j("severity"), j("level"), F.lit("info")), SEVERITIES, "info").alias("severity"),
        F.lit("json").alias("source"), F.substring(subject, 1, 150).alias("subject"),
        F.substring(F.coalesce(j("action"), j("operation"), F.lit("occurred")), 1, 150).alias("action"),
        F.substring(F.coalesce(j("object"), j("target"), j("path"), file), 1, 250).alias("object"),
        F.coalesce(n("_ho", "hostname"), j("hostname"), F.when(F.col("_ho").isNull(), j("host"))).alias("hostname"),
        F.coalesce(n("_ho", "ip"), j("ip")).alias("host_ip"), person.alias("username"),
        F.coalesce(n("_u", "domain"), j("domain")).alias("user_domain"),
        int_guard(F.coalesce(n("_p", "pid"), j("pid"))).cast(big).alias("pid"), int_guard(F.coalesce(n("_p", "ppid"), j("ppid"))).alias("ppid"),
        F.coalesce(n("_p", "name"), j("process_name")).alias("process_name"), F.coalesce(n("_p", "path"), j("path")).alias("process_path"),
        F.coalesce(n("_p", "command_line"), j("cmdline")).alias("command_line"), F.coalesce(n("_p", "hash"), j("sha256")).alias("process_hash"),
        int_guard(j("ppid")).alias("parent_pid"), j("parent_process").alias("parent_process_name"),
        j("filename").alias("file_name"), F.coalesce(j("filepath"), j("path")).alias("file_path"),
        j("md5").alias("file_md5"), j("sha1").alias("file_sha1"), j("sha256").alias("file_sha256"),
        F.coalesce(n("_n", "source_ip"), j("src_ip")).alias("source_ip"), int_guard(F.coalesce(n("_n", "source_port"), j("src_port"))).alias("source_port"),
        F.coalesce(n("_n", "destination_ip"), j("dst_ip")).alias("destination_ip"),
        int_guard(F.coalesce(n("_n", "destination_port"), j("dst_port"))).alias("destination_port"),
        F.coalesce(n("_n", "protocol"), j("protocol"), F.lit("TCP")).alias("protocol"), F.coalesce(n("_n", "domain"), j("domain")).alias("domain"),
        n("_n", "dns_query").alias("dns_query"), F.coalesce(n("_n", "url"), j("url")).alias("url"), n("_n", "direction").alias("direction"),
        j("registry_key").alias("registry_key"), j("service_name").alias("service_name"), F.col(item).alias("details"),
        techniques.alias("mitre_techniques"), file.alias("source_file"), F.lit(1.0).alias("confidence"), F.lit("json_parser").alias("extraction_method"),
    ))


def text_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """Whole text files to numbered lines."""
    rest = [c for c in df.columns if c != content]
    return df.select(*rest, F.posexplode(F.split(content, LINE_BREAK)).alias("_p", "line")).withColumn(
        "line_number", (F.col("_p") + 1).cast("bigint")).drop("_p")


def text(df: DataFrame, source_file: Column | str | None = None, default_ts: Column | None = None, compat: bool = False) -> DataFrame:
    """Log lines (``line``, ``line_number``): first address, URL, path, hash and user of each."""
    file = _file(source_file, "log_file")
    rows = df.withColumn("_l", strip(F.col("line"))).filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    line, low = F.col("_l"), F.lower("_l")
    rows = (
        rows.withColumn("_ip", first_ip(line)).withColumn("_url", first_url(line)).withColumn("_path", first_path(line, compat))
        .withColumn("_hash", first_hash(line)).withColumn("_user", first_user(line))
    )
    bad = low.contains("error") | low.contains("fail") | low.contains("denied")
    size = F.length("_hash")
    return conform(rows.select(
        *[c for c in ("case_id", "evidence_id", "organization_id") if c in df.columns],
        _default_ts(default_ts).alias("ts"), F.lit("generic").alias("event_type"), F.lit("text").alias("source"),
        F.when(bad, "medium").otherwise("info").alias("severity"), file.alias("subject"), F.lit("log_entry").alias("action"),
        F.substring(line, 1, 200).alias("object"), F.lit("LogHost" if compat else None).alias("hostname"), F.col("_ip").alias("host_ip"),
        F.col("_user").alias("username"), F.col("_path").alias("process_path"), F.col("_hash").alias("process_hash"),
        F.col("_path").alias("file_path"), F.col("_path").alias("file_name"), F.when(size == 32, F.col("_hash")).alias("file_md5"),
        F.when(size == 64, F.col("_hash")).alias("file_sha256"), F.col("_ip").alias("source_ip"), F.lit("TCP").alias("protocol"),
        F.col("_url").alias("url"), F.to_json(F.struct(F.col("line").alias("raw_line"), "line_number")).alias("details"),
        F.array().cast("array<string>").alias("mitre_techniques"), file.alias("source_file"),
        F.col("line_number") if "line_number" in df.columns else F.lit(None).alias("line_number"),
        F.lit(0.85).alias("confidence"), F.lit("precompiled_regex_patterns").alias("extraction_method"),
    ))


def hashes(df: DataFrame, source_file: Column | str | None = None, default_ts: Column | None = None) -> DataFrame:
    """Hash manifest lines ``hash  filename``; other lines are ignored."""
    line = strip(F.col("line"))
    rows = df.withColumn("_h", F.lower(F.regexp_extract(line, HASH_LINE, 1))).withColumn(
        "_f", first_filled(strip(F.regexp_extract(line, HASH_LINE, 2)), F.lit("unknown_file"))).filter("_h <> ''")
    h, n = F.col("_h"), F.length("_h")
    kind = hash_kind(h)
    return conform(rows.select(
        *[c for c in ("case_id", "evidence_id", "organization_id") if c in df.columns],
        _default_ts(default_ts).alias("ts"), F.lit("hash_record").alias("event_type"), F.lit("text").alias("source"), F.lit("info").alias("severity"),
        F.col("_f").alias("subject"), F.lit("hash_recorded").alias("action"), F.concat(kind, F.lit(":"), h).alias("object"),
        F.col("_f").alias("file_name"), F.col("_f").alias("file_path"), F.when(n == 32, h).alias("file_md5"),
        F.when(n == 40, h).alias("file_sha1"), F.when(n == 64, h).alias("file_sha256"),
        F.to_json(F.struct(kind.alias("hash_type"), h.alias("hash_value"), F.col("_f").alias("associated_file"))).alias("details"),
        F.array().cast("array<string>").alias("mitre_techniques"), _file(source_file, "hash_file").alias("source_file"),
        F.lit(1.0).alias("confidence"), F.lit("hash_line_regex").alias("extraction_method"),
    ))


def _visits(rows: DataFrame, ts: Column, subject: str, default_ts: Column | None) -> DataFrame:
    sev = url_severity(F.col("url"))
    return conform(rows.select(
        *[c for c in ("case_id", "evidence_id", "organization_id") if c in rows.columns],
        F.coalesce(ts, _default_ts(default_ts)).alias("ts"), F.lit("browser_history").alias("event_type"), F.lit("browser").alias("source"),
        sev.alias("severity"), F.lit(subject).alias("subject"), F.lit("visited").alias("action"), F.col("url").alias("object"), "url",
        F.to_json(F.struct("title", "visit_count", F.col("raw_time").alias("raw_time"))).alias("details"),
        F.when(sev != "info", tag_text(F.col("url"))).otherwise(F.array().cast("array<string>")).alias("mitre_techniques"),
    ))


def chrome(visits: DataFrame, urls: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """One event per visit. ``visits(url, visit_time)``, ``urls(id, url, title, visit_count)``."""
    v = visits.withColumnRenamed("url", "url_id")
    rows = visits_with_urls(v, urls, "url_id").withColumnRenamed("visit_time", "raw_time")
    return _visits(rows, from_chrome_micros(F.col("raw_time")), "ChromeProcess", default_ts)


def chrome_urls(urls: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """Without a visits table: one event per URL at its last visit."""
    rows = urls.withColumnRenamed("last_visit_time", "raw_time")
    return _visits(rows, from_chrome_micros(F.col("raw_time")), "ChromeProcess", default_ts)


def firefox(visits: DataFrame, places: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """``visits(place_id, visit_date)`` with a date, ``places(id, url, title, visit_count)``."""
    rows = visits_with_urls(visits.filter("visit_date is not null"), places, "place_id").withColumnRenamed("visit_date", "raw_time")
    return _visits(rows, from_firefox_micros(F.col("raw_time")), "FirefoxProcess", default_ts)


def firefox_places(places: DataFrame, default_ts: Column | None = None) -> DataFrame:
    rows = places.filter("last_visit_date is not null").withColumnRenamed("last_visit_date", "raw_time")
    return _visits(rows, from_firefox_micros(F.col("raw_time")), "FirefoxProcess", default_ts)


def packets(df: DataFrame, source_file: Column | str | None = None, compat: bool = False) -> DataFrame:
    """Decoded packets (ts, src_ip, dst_ip, proto, ttl, length, sport, dport, flags, dns_query, http_host, http_path)."""
    name = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").otherwise("IP")
    risky = is_risky_port(F.col("dport"))
    dns = blank_to_null(F.regexp_replace("dns_query", r"\.+$", ""))
    is_http = F.col("http_host").isNotNull() | F.col("http_path").isNotNull()
    host = first_filled(F.col("http_host"), F.col("dst_ip"))
    url = F.when(is_http, F.concat(F.lit("http://"), host, first_filled(F.col("http_path"), F.lit("/"))))
    return conform(df.filter(F.col("src_ip").isNotNull()).select(
        *[c for c in ("case_id", "evidence_id", "organization_id") if c in df.columns],
        "ts", F.lit("network_connection").alias("event_type"), F.lit("pcap").alias("source"),
        F.when(risky, "medium").otherwise("info").alias("severity"), F.col("src_ip").alias("subject"),
        F.concat(F.lit("sent_"), F.lower(name), F.lit("_packet")).alias("action"),
        F.when(F.col("dport") != 0, F.concat_ws(":", "dst_ip", F.col("dport").cast("string"))).otherwise(F.col("dst_ip")).alias("object"),
        F.lit("NetworkHost" if compat else None).alias("hostname"), F.col("src_ip").alias("host_ip"), F.col("src_ip").alias("source_ip"),
        F.col("sport").alias("source_port"), F.col("dst_ip").alias("destination_ip"), F.col("dport").alias("destination_port"),
        name.alias("protocol"), F.when(is_http, host).otherwise(dns).alias("domain"), dns.alias("dns_query"), url.alias("url"),
        direction(F.col("src_ip")).alias("direction"),
        F.to_json(F.struct("length", "ttl", F.col("proto").alias("proto_code"), "sport", "dport", "flags", dns.alias("dns_query"), url.alias("http_url"))).alias("details"),
        F.when(risky, tag_text(F.col("dport").cast("string"))).otherwise(F.array().cast("array<string>")).alias("mitre_techniques"),
        _file(source_file, "pcap_file").alias("source_file"), F.lit(1.0).alias("confidence"), F.lit("packet_rows").alias("extraction_method"),
    ))


# file types of text content and their normalisers; extend with ``register``
_TEXT_TYPES: dict[str, Callable[[DataFrame, Column | None], DataFrame]] = {}


def register(file_type: str, normaliser: Callable[[DataFrame, Column | None], DataFrame]) -> None:
    """Add a format: ``normaliser(files, default_ts) -> events`` over (source_file, content, ids)."""
    _TEXT_TYPES[file_type] = normaliser


def unregister(file_type: str) -> None:
    """Forget a format; events already asked for are not touched."""
    _TEXT_TYPES.pop(file_type, None)


def _csv_files(files: DataFrame, ts: Column | None) -> DataFrame:
    records = files.withColumn("_records", csv_records(F.col("content"))).withColumn("_header", F.get("_records", 0))
    lines = records.withColumn("_line", F.explode(F.slice("_records", 2, 1 << 30))).drop("content", "_records")
    return csv_lines(lines, F.col("_header"), F.col("_line"), F.col("source_file"), ts)


register("csv", _csv_files)
register("json", lambda f, ts: json(json_items(f), F.col("source_file"), ts))
register("text", lambda f, ts: text(text_lines(f), F.col("source_file"), ts))
register("hash", lambda f, ts: hashes(text_lines(f), F.col("source_file"), ts))


def dispatch(files: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """Choose the normaliser by file type and union the results.

    ``files`` has file_type, source_file, content and the scope ids. Hash
    manifests go to the manifest reader by extension; unknown types are JSON.
    """
    ext = F.lower(F.element_at(F.split("source_file", r"\."), -1))
    kind = (
        F.when(ext.isin("md5", "sha1", "sha256", "hash"), "hash")
        .when(F.lower("file_type").isin("text", "log", "txt"), "text")
        .when(F.lower("file_type").isin(list(_TEXT_TYPES)), F.lower("file_type")).otherwise("json")
    )
    typed = files.withColumn("_kind", kind)
    out = None
    for name, fn in _TEXT_TYPES.items():
        part = fn(typed.filter(F.col("_kind") == name).drop("_kind", "file_type"), default_ts)
        out = part if out is None else out.unionByName(part)
    return out


def _single(record: Column) -> Column:
    """A record without the rest of its line end; a lone carriage return outside of quotes ends a record too."""
    return F.explode(F.when(record.contains("\r"), csv_records(record)).when(record == "", F.array().cast("array<string>")).otherwise(F.array(record)))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV files with one header, all columns text; large files are split over tasks.

    With ``multi_line`` a line break may stand within quotes, as in ``dispatch``:
    the state at each block's begin is found first (``blocks.csv_blocks``).
    Without it Spark's own reader is used, which is right for files whose cells
    hold no line breaks.
    """
    options = {"header": True, "escape": '"', "maxColumns": 1 << 20}
    if not multi_line:
        return spark.read.csv(path, **options)
    names = spark.read.csv(path, multiLine=True, **options).columns  # reads one record
    if not names:
        return spark.createDataFrame([], T.StructType())
    rows = csv_blocks(spark, path).filter(~F.col("header")).select(_single(F.col("record")).alias("record"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "maxColumns": str(1 << 20)}).alias("c"))
    return cells.select(*[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)])


def read_csv_records(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """(source_file, header, line) for ``csv_lines``: records of CSV files that each have a header of their own.

    A file of one block brings at most a block of rows to its header. Files of
    more blocks are fewer than blocks are, so their headers are broadcast.
    """
    found = csv_blocks(spark, path, least)
    heads = found.filter("header").select("file", "alone", F.col("record").alias("header"))
    rows = found.filter(~F.col("header")).drop("header", "block", "no")
    few = rows.filter("alone").drop("alone").join(heads.filter("alone").select("file", "header"), "file")
    many = rows.filter("not alone").drop("alone").join(F.broadcast(heads.filter("not alone").select("file", "header")), "file")
    both = few.unionByName(many).withColumn("header", F.get(csv_records(F.col("header")), 0))
    return both.select("source_file", "header", _single(F.col("record")).alias("line"))


ROW_LIMIT = 1 << 30  # files of so many bytes are not read as one row


def dispatch_path(spark: SparkSession, path: str, default_ts: Column | None = None, limit: int = ROW_LIMIT) -> DataFrame:
    """Events of all files in a folder, whatever their size; the type comes from content and name.

    Files below ``limit`` bytes go through ``dispatch``. Larger ones are read in
    blocks: CSV by records, text and hash lists by lines (without line numbers),
    all others as one JSON object a line.
    """
    small = files_below(spark, path, limit).select(
        F.col("filename").alias("source_file"), file_type(F.col("content"), F.col("filename")).alias("file_type"), F.col("content").cast("string").alias("content"))
    out = dispatch(small, default_ts)
    names = spark.read.format("binaryFile").load(path).select("path", "length").filter(F.col("length") >= limit)
    if names.isEmpty():
        return out
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_size").alias("_size")).filter(F.col("_size") >= limit).drop("_size").withColumn("line_number", F.lit(None).cast("bigint"))
    kind = file_type(F.lit(b""), F.col("source_file"))
    hashed = extension(F.col("source_file")).isin(HASH_EXTENSIONS)
    records = read_csv_records(spark, path, limit).filter(kind == "csv")
    parts = [
        csv_lines(records, F.col("header"), F.col("line"), F.col("source_file"), default_ts),
        hashes(lines.filter(hashed), F.col("source_file"), default_ts), text(lines.filter((kind == "text") & ~hashed), F.col("source_file"), default_ts),
        json(lines.filter(kind == "json").withColumnRenamed("line", "item"), F.col("source_file"), default_ts)]
    for p in parts:
        out = out.unionByName(p)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file; large files are split over tasks."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source_file"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("item"), F.col("_metadata.file_name").alias("source_file"))
