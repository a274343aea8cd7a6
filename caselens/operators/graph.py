"""Events to nodes and edges, idempotent upsert, propagation, deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.network import domain_of, is_private_ip
from caselens.functions.text import int_guard
from caselens.operators.filters import anomalous
from caselens.schema import first_filled
from caselens.session import materialize, without_shuffles

# Placeholders which stand for a missing host, user or process.
DEFAULT_HOST, DEFAULT_USER, DEFAULT_PROCESS = "DESKTOP-DEFAULT", "administrator", "process"

DETAIL_KEYS = [
    "Computer", "Host", "TargetUserName", "User", "TargetDomainName", "Domain", "ProcessName",
    "ProcessId", "CommandLine", "Hash", "SHA256", "ParentProcessName", "DestinationIP", "IpAddress",
    "DestinationPort", "Port", "DomainName", "QueryName", "ObjectName", "ServiceName", "FileName",
]
NODE_COLUMNS = [
    "node_id", "label", "case_id", "evidence_id", "name", "pid", "command_line", "process_hash",
    "is_private", "ts", "severity", "event_type", "source", "is_anomaly", "anomaly_score",
]
EDGE_COLUMNS = [
    "src", "src_label", "dst", "dst_label", "rel_type", "case_id", "evidence_id", "event_id", "ts",
    "is_anomaly", "anomaly_score",
]
EVENT_LABELS = ["Event", "BrowserVisit"]


def is_browser() -> Column:
    return F.lower(F.coalesce("source", F.lit(""))) == "browser"


def route(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Browser rows and all others; decided for every row."""
    return events.filter(is_browser()), events.filter(~is_browser())


def flatten(events: DataFrame, compat: bool = False) -> DataFrame:
    """Graph fields: normalised field first, then the known keys of ``details``.

    ``compat`` lets the subject stand in for a missing process name.
    """
    d = F.from_json("details", ", ".join(f"{k} string" for k in DETAIL_KEYS))
    df = events.withColumn("_d", d)

    def det(key: str) -> Column:
        return F.col("_d")[key]

    kind = F.col("event_type")
    proc = [F.col("process_name"), F.col("process_path"), det("ProcessName")]
    port = F.coalesce(
        F.when(F.col("destination_port") != 0, F.col("destination_port")), F.col("source_port"),
        int_guard(det("DestinationPort")), int_guard(det("Port")),
    )
    return df.select(
        "event_id", "case_id", "evidence_id", "ts", "event_type", "source", "severity", "action",
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        first_filled(F.col("hostname"), F.col("host_ip"), det("Computer"), det("Host")).alias("g_host"),
        first_filled(F.col("username"), det("TargetUserName"), det("User")).alias("g_user"),
        first_filled(F.col("user_domain"), det("TargetDomainName"), det("Domain"), F.lit("WORKGROUP")).alias("g_user_domain"),
        first_filled(*proc, *([F.col("subject")] if compat else [])).alias("g_process"),
        F.coalesce(F.col("pid"), int_guard(det("ProcessId")), F.lit(0)).alias("g_pid"),
        first_filled(F.col("command_line"), det("CommandLine")).alias("g_command"),
        first_filled(F.col("process_hash"), det("Hash"), det("SHA256")).alias("g_hash"),
        first_filled(F.col("parent_process_name"), det("ParentProcessName")).alias("g_parent"),
        F.coalesce("parent_pid", F.lit(0)).alias("g_parent_pid"),
        first_filled(F.col("destination_ip"), F.col("source_ip"), det("DestinationIP"), det("IpAddress")).alias("g_ip"),
        F.when(port != 0, port).alias("g_port"),
        first_filled(F.col("domain"), F.col("dns_query"), det("DomainName"), det("QueryName")).alias("g_domain"),
        first_filled(F.col("registry_key"), F.when(kind == "registry_change", det("ObjectName"))).alias("g_registry"),
        first_filled(
            F.col("file_path"), F.when(kind.isin("file_creation", "file_modification"), det("ObjectName")),
            F.col("file_sha256"), det("SHA256"), F.col("file_name"), det("FileName"),
        ).alias("g_file"),
        first_filled(F.col("service_name"), det("ServiceName")).alias("g_service"),
    )


def flatten_browser(events: DataFrame, strip_mode: str = "prefix") -> DataFrame:
    url = F.coalesce("url", "object")
    d = F.col("_d")
    return events.withColumn("_d", F.from_json("details", "title string, visit_count bigint")).select(
        "event_id", "case_id", "evidence_id", "ts", "event_type", "source", "severity",
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        url.alias("g_url"), F.coalesce(d.title, F.lit("")).alias("g_title"),
        F.coalesce(d.visit_count, F.lit(1)).alias("g_visit_count"),
        domain_of(url, strip_mode).alias("g_domain"),
    )


def node_key(label: str, *parts: Column) -> Column:
    """``label:part:part``; NULL when any part is."""
    return F.concat(F.lit(label.lower() + ":"), *[
        x for i, p in enumerate(parts) for x in ((F.lit(":"), p) if i else (p,))
    ])


def raw_key(node_id: Column) -> Column:
    """Node id without its label prefix."""
    return F.regexp_replace(node_id, "^[a-z]+:", "")


def _keys(compat: bool, parent_pid: str) -> dict[str, Column]:
    case = F.col("case_id")
    host_text = F.coalesce("g_host", F.lit(DEFAULT_HOST))
    user_ok = F.lit(True) if not compat else F.coalesce(F.col("g_user") != DEFAULT_USER, F.lit(False))
    host_ok = F.col("g_host") != DEFAULT_HOST
    ppid = F.col("g_parent_pid").cast("string") if parent_pid == "actual" else F.lit("0")
    proc = F.when(
        F.col("g_process") != DEFAULT_PROCESS,
        node_key("Process", case, host_text, F.col("g_pid").cast("string"), F.col("g_process")),
    )
    return {
        "Case": node_key("Case", case), "Evidence": node_key("Evidence", F.col("evidence_id")),
        "Event": node_key("Event", F.col("event_id")),
        "Host": F.when(host_ok, node_key("Host", case, F.col("g_host"))),
        "User": F.when(user_ok, node_key("User", case, F.concat(F.col("g_user_domain"), F.lit("\\"), F.col("g_user")))),
        "Process": proc,
        "Parent": F.when(proc.isNotNull(), node_key("Process", case, host_text, ppid, F.col("g_parent"))),
        "IPAddress": node_key("IPAddress", case, F.col("g_ip")),
        "Port": F.when(F.col("g_ip").isNotNull(), node_key("Port", case, F.col("g_port").cast("string"), F.lit("TCP"))),
        "Domain": node_key("Domain", case, F.col("g_domain")),
        "RegistryKey": node_key("RegistryKey", case, F.col("g_registry")),
        "File": node_key("File", case, F.col("g_file")),
        "Service": node_key("Service", case, host_text, F.col("g_service")),
    }


def _web_keys() -> dict[str, Column]:
    case = F.col("case_id")
    return {
        "Case": node_key("Case", case), "Evidence": node_key("Evidence", F.col("evidence_id")),
        "BrowserVisit": node_key("BrowserVisit", F.col("event_id")),
        "Domain": node_key("Domain", case, F.col("g_domain")),
    }


def _flats(events: DataFrame, compat: bool) -> tuple[DataFrame, DataFrame]:
    """Graph fields of generic and of browser rows, written once: every relation and label then reads its few columns."""
    web, generic = route(events)
    flats = flatten(generic, compat), flatten_browser(web)
    return flats if events.isStreaming else tuple(materialize(f, "flat") for f in flats)


# source key, relation, target key, and which properties identify the edge:
# e = evidence, t = timestamp, i = event id
_GENERIC_EDGES = [
    ("Case", "HAS_EVIDENCE", "Evidence", ""), ("Evidence", "CONTAINS_EVENT", "Event", "e"),
    ("Event", "OCCURRED_ON", "Host", "e"), ("Event", "INVOLVES_USER", "User", "e"),
    ("Event", "INVOLVES_PROCESS", "Process", "e"), ("User", "EXECUTED", "Process", "et"),
    ("Parent", "SPAWNED", "Process", "eti"), ("Process", "CONNECTED_TO", "IPAddress", "eti"),
    ("IPAddress", "USES_PORT", "Port", ""), ("Process", "RESOLVED", "Domain", "et"),
    ("Domain", "RESOLVES_TO", "IPAddress", ""), ("Process", "MODIFIED_REGISTRY", "RegistryKey", "et"),
    ("Process", "CREATED", "File", "et"), ("Process", "CREATED_SERVICE", "Service", "et"),
]
_BROWSER_EDGES = [
    ("Case", "HAS_EVIDENCE", "Evidence", ""), ("Evidence", "CONTAINS_VISIT", "BrowserVisit", ""),
    ("BrowserVisit", "VISITED_DOMAIN", "Domain", "e"),
]


def labels_of(rels: list[str]) -> list[str]:
    """Labels of the nodes at the ends of these relations."""
    ends = {x for a, rel, b, _ in _GENERIC_EDGES + _BROWSER_EDGES if rel in rels for x in (a, b)}
    return sorted("Process" if x == "Parent" else x for x in ends)


def _edges(flat: DataFrame, keys: dict[str, Column], spec: list[tuple[str, str, str, str]]) -> list[DataFrame]:
    """The edges of each relation by themselves, not yet distinct."""
    hot = anomalous(F.col("is_anomaly"), F.col("anomaly_score"))
    rows = []
    for a, rel, b, props in spec:
        touches_event = a in EVENT_LABELS or b in EVENT_LABELS
        rows.append(flat.select(
            keys[a].alias("src"), F.lit("Process" if a == "Parent" else a).alias("src_label"),
            keys[b].alias("dst"), F.lit(b).alias("dst_label"), F.lit(rel).alias("rel_type"), "case_id",
            (F.col("evidence_id") if "e" in props else F.lit(None).cast("string")).alias("evidence_id"),
            (F.col("event_id") if "i" in props else F.lit(None).cast("string")).alias("event_id"),
            (F.col("ts") if "t" in props else F.lit(None).cast("timestamp_ntz")).alias("ts"),
            (F.when(hot, True) if touches_event else F.lit(None).cast("boolean")).alias("is_anomaly"),
            (F.when(hot, F.col("anomaly_score")) if touches_event else F.lit(None).cast("double")).alias("anomaly_score"),
        ).filter("src is not null and dst is not null"))
    return rows


def graph_of(events: DataFrame, parent_pid: str = "zero", compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges over the same flattened rows, see ``nodes_of`` and ``edges_of``."""
    flat, wflat = _flats(events, compat)
    return _nodes(flat, wflat, parent_pid, compat), _all_edges(flat, wflat, parent_pid, compat)


def edges_of(events: DataFrame, parent_pid: str = "zero", compat: bool = False) -> DataFrame:
    """All edges of the graph, each once.

    Edges that touch an event carry its anomaly state already, so building the
    graph needs no second join to propagate it.
    """
    return _all_edges(*_flats(events, compat), parent_pid, compat)


def _all_edges(flat: DataFrame, wflat: DataFrame, parent_pid: str, compat: bool) -> DataFrame:
    parts = _edges(flat, _keys(compat, parent_pid), _GENERIC_EDGES) + _edges(wflat, _web_keys(), _BROWSER_EDGES)
    return reduce(DataFrame.unionByName, parts).distinct()


def process_of(events: DataFrame, parent_pid: str = "zero") -> DataFrame:
    """(case_id, ts, node_id, name) of the process that each event involves."""
    flat = flatten(route(events)[1])
    key = _keys(False, parent_pid)["Process"]
    return flat.select("case_id", "ts", key.alias("node_id"), F.col("g_process").alias("name")).filter("node_id is not null")


def _typed(df: DataFrame) -> DataFrame:
    types = {
        "pid": "bigint", "is_private": "boolean", "ts": "timestamp_ntz", "is_anomaly": "boolean",
        "anomaly_score": "double",
    }
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in NODE_COLUMNS
    ])


def _event_nodes(df: DataFrame, label: str, name: str) -> DataFrame:
    key = node_key(label, F.col("event_id"))
    return _typed(df.select(
        key.alias("node_id"), F.lit(label).alias("label"), "case_id", "evidence_id", F.col(name).alias("name"),
        "ts", "severity", "event_type", "source", "is_anomaly", "anomaly_score",
    ))


def nodes_of(events: DataFrame, parent_pid: str = "zero", compat: bool = False) -> DataFrame:
    """All nodes, each once, with the anomaly state of the events around them.

    Entity properties follow from the key, except for command line and hash of a
    process: the latest event wins.
    """
    return _nodes(*_flats(events, compat), parent_pid, compat)


def _nodes(flat: DataFrame, wflat: DataFrame, parent_pid: str, compat: bool) -> DataFrame:
    k, wk = _keys(compat, parent_pid), _web_keys()
    hot = anomalous(F.col("is_anomaly"), F.col("anomaly_score"))
    score = F.when(hot, F.col("anomaly_score"))
    none = F.lit(None)

    def ent(df: DataFrame, label: str, key: Column, name: Column, *extra: Column, near: bool = False) -> DataFrame:
        return df.select(
            key.alias("node_id"), F.lit(label).alias("label"), "case_id", name.cast("string").alias("name"),
            (score if near else none.cast("double")).alias("score"), *extra).filter("node_id is not null")

    def plain(df: DataFrame, label: str, key: Column, name: Column, *, evidence: Column = none, private: Column = none, near: bool = False) -> DataFrame:
        return ent(df, label, key, name, evidence.cast("string").alias("evidence_id"), private.cast("boolean").alias("is_private"), near=near)

    def proc(key: Column, name: Column, latest: Column = none, pid: Column = none, near: bool = False) -> DataFrame:
        kind = "struct<ts:timestamp_ntz,event_id:string,command_line:string,process_hash:string>"
        return ent(flat, "Process", key, name, latest.cast(kind).alias("latest"), pid.cast("bigint").alias("pid"), near=near)

    ev_id, case = F.col("evidence_id"), F.col("case_id")
    latest = F.struct(F.col("ts"), F.col("event_id"), F.col("g_command"), F.col("g_hash"))
    rows = [
        plain(flat, "Case", k["Case"], case), plain(flat, "Evidence", k["Evidence"], ev_id, evidence=ev_id, near=True),
        plain(flat, "Host", k["Host"], F.col("g_host"), near=True), plain(flat, "User", k["User"], F.col("g_user"), near=True),
        plain(flat, "IPAddress", k["IPAddress"], F.col("g_ip"), private=is_private_ip(F.col("g_ip"))),
        plain(flat, "Port", k["Port"], F.col("g_port")), plain(flat, "Domain", k["Domain"], F.col("g_domain")),
        plain(flat, "RegistryKey", k["RegistryKey"], F.col("g_registry")), plain(flat, "File", k["File"], F.col("g_file")),
        plain(flat, "Service", k["Service"], F.col("g_service")),
        plain(wflat, "Case", wk["Case"], case), plain(wflat, "Evidence", wk["Evidence"], ev_id, evidence=ev_id, near=True),
        plain(wflat, "Domain", wk["Domain"], F.col("g_domain"), near=True),
    ]
    others = reduce(DataFrame.unionByName, rows).groupBy("node_id", "label", "case_id", "evidence_id", "name", "is_private").agg(
        F.max("score").alias("anomaly_score")
    )
    procs = proc(k["Process"], F.col("g_process"), latest, F.col("g_pid"), near=True).unionByName(proc(k["Parent"], F.col("g_parent")))
    procs = procs.groupBy("node_id", "label", "case_id", "name").agg(
        F.max("score").alias("anomaly_score"), F.max("latest").alias("latest"), F.max("pid").alias("pid")
    ).select("*", "latest.command_line", "latest.process_hash").drop("latest")
    flag = F.when(F.col("anomaly_score").isNotNull(), True)
    return (
        _typed(others.withColumn("is_anomaly", flag))
        .unionByName(_typed(procs.withColumn("is_anomaly", flag)))
        .unionByName(_event_nodes(flat, "Event", "event_type"))
        .unionByName(_event_nodes(wflat, "BrowserVisit", "g_url"))
    )


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write wins per node: loading twice equals loading once."""
    rows = stored.withColumn("_g", F.lit(0)).unionByName(incoming.withColumn("_g", F.lit(1)))
    rest = [c for c in stored.columns if c != "node_id"]
    return rows.groupBy("node_id").agg(F.max(F.struct("_g", *rest)).alias("m")).select("node_id", *[f"m.{c}" for c in rest])


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    keys = ["src", "dst", "rel_type", "case_id", "evidence_id", "event_id", "ts"]
    labels = ["src_label", "dst_label"]
    return stored.unionByName(incoming).groupBy(*keys, *labels).agg(
        F.bool_or("is_anomaly").alias("is_anomaly"), F.max("anomaly_score").alias("anomaly_score")
    ).select(*EDGE_COLUMNS)


def propagate(nodes: DataFrame, edges: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread event scores (event_id, flag, score) to touching edges and their other ends.

    An edge of an event names it in its own key, so one equi-join on the event
    node finds all of them; edges between entities are left alone.
    """
    hot = scores.filter(anomalous(F.col("flag"), F.col("score"))).select(
        F.explode(F.array(*[node_key(x, F.col("event_id")) for x in EVENT_LABELS])).alias("_event"),
        F.col("score").alias("_s"),
    )
    at_src = F.col("src_label").isin(EVENT_LABELS)
    of_event = edges.filter(at_src | F.col("dst_label").isin(EVENT_LABELS)).withColumn(
        "_event", F.when(at_src, F.col("src")).otherwise(F.col("dst"))
    )
    lit = of_event.join(hot, "_event", "left")
    lit = lit.withColumn("_other", F.when(at_src, F.col("dst")).otherwise(F.col("src")))
    touched = lit.filter(F.col("_s").isNotNull()).groupBy(F.col("_other").alias("node_id")).agg(F.max("_s").alias("_s"))
    new_edges = (
        lit.withColumn("is_anomaly", F.when(F.col("_s").isNotNull(), True).otherwise(F.col("is_anomaly")))
        .withColumn("anomaly_score", F.greatest("anomaly_score", "_s")).select(*EDGE_COLUMNS)
        .unionByName(edges.filter(~(at_src | F.col("dst_label").isin(EVENT_LABELS))).select(*EDGE_COLUMNS))
    )
    new_nodes = (
        nodes.join(touched, "node_id", "left")
        .withColumn("is_anomaly", F.when(F.col("_s").isNotNull(), True).otherwise(F.col("is_anomaly")))
        .withColumn("anomaly_score", F.greatest("anomaly_score", "_s")).select(*NODE_COLUMNS)
    )
    return new_nodes, new_edges


def delete_evidence(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove event, visit and evidence nodes of the doomed (case_id, evidence_id), with their edges.

    Shared entities stay.
    """
    own = F.col("label").isin("Event", "BrowserVisit", "Evidence")
    gone = nodes.filter(own).join(doomed, ["case_id", "evidence_id"], "left_semi").select("node_id")
    kept_nodes = nodes.join(gone, "node_id", "left_anti")
    kept_edges = edges.join(gone, edges["src"] == gone["node_id"], "left_anti").join(
        gone, edges["dst"] == gone["node_id"], "left_anti"
    )
    return kept_nodes, kept_edges


def clear_case(nodes: DataFrame, edges: DataFrame, case_id: str) -> tuple[DataFrame, DataFrame]:
    return nodes.filter(F.col("case_id") != case_id), edges.filter(F.col("case_id") != case_id)


def export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes once per id; edges with both ends present and any-of anomaly flag."""
    n = materialize(nodes.dropDuplicates(["node_id"]), "export-nodes")
    ends = n.select("node_id", F.coalesce("is_anomaly", F.lit(False)).alias("_a"))
    e = (
        edges.join(ends.select(F.col("node_id").alias("src"), F.col("_a").alias("_sa")), "src")
        .join(ends.select(F.col("node_id").alias("dst"), F.col("_a").alias("_da")), "dst")
        .withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)) | F.col("_sa") | F.col("_da"))
        .drop("_sa", "_da")
    )
    return n, e.select(*EDGE_COLUMNS)


# Relations of as many edges as there are events are written one after the other, the others together.
WRITTEN_ALONE = ["CONTAINS_EVENT", "OCCURRED_ON", "INVOLVES_USER", "INVOLVES_PROCESS", "EXECUTED", "SPAWNED"]


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Export as JSON lines in gzip under ``path``/nodes and ``path``/edges; times keep microseconds.

    Edges are written by relation and shuffle files go with each part, so the
    disk holds the shuffles of one part at a time.
    """
    alone = F.coalesce(F.col("rel_type").isin(WRITTEN_ALONE), F.lit(False))
    parts = [~alone, *[F.col("rel_type") == r for r in WRITTEN_ALONE]]
    with without_shuffles(nodes.sparkSession):
        n, e = export(nodes, edges)
        _write_json(n, f"{path}/nodes")
        for i, part in enumerate(parts):
            _write_json(e.filter(part), f"{path}/edges", "append" if i else "overwrite")


def _write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode(mode).option("timestampNTZFormat", fmt).option("compression", "gzip").json(path)
