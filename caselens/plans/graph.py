"""Graph construction, views, traversal and rules over the canonical events."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.operators import aggregates as ag
from caselens.operators import correlate as co
from caselens.operators import entities as en
from caselens.operators import graph as gr
from caselens.operators import joins as jn
from caselens.operators import traverse as tr
from caselens.operators import views as vw
from caselens.plans.registry import query
from caselens.plans.timeline import EV
from caselens.sources.adapt import canonical_events, table

# ---- the graph as SQL ------------------------------------------------------

_SRC = {
    "Case": "'case:'||case_id", "Evidence": "'evidence:'||evidence_id", "Event": "'event:'||event_id",
    "Host": "'host:'||case_id||':'||hostname",
    "User": "'user:'||case_id||':'||coalesce(user_domain,'WORKGROUP')||chr(92)||username",
    "Process": "'process:'||case_id||':'||hostname||':'||pid||':'||process_name",
    "IPAddress": "'ipaddress:'||case_id||':'||destination_ip", "Port": "'port:'||case_id||':'||destination_port||':TCP'",
    "Domain": "'domain:'||case_id||':'||domain", "RegistryKey": "'registrykey:'||case_id||':'||registry_key",
    "File": "'file:'||case_id||':'||file_path", "Service": "'service:'||case_id||':'||hostname||':'||service_name",
}
_WEB_DOMAIN = "CASE WHEN url IS NULL THEN object ELSE 'site'||(k%20)||'.example.com' END"


def graph_sql(ppid: str = "'0'") -> str:
    """CTEs ``nodes`` and ``edges``; ``ppid`` is '0' or parent_pid."""
    parent = f"'process:'||case_id||':'||hostname||':'||{ppid}||':'||parent_process_name"
    src = {**_SRC, "Parent": parent}
    hot = "CASE WHEN is_anomaly OR anomaly_score>0.5 THEN {} END"

    def edge(a, rel, b, props, keys=src, table="g"):
        touch = "Event" in (a, b) or "BrowserVisit" in (a, b)
        label = "Process" if a == "Parent" else a
        return (
            f"SELECT {keys[a]} AS src, '{label}' AS src_label, {keys[b]} AS dst, '{b}' AS dst_label, '{rel}' AS rel_type, case_id,"
            f" {'evidence_id' if 'e' in props else 'NULL::VARCHAR'} AS evidence_id, {'event_id' if 'i' in props else 'NULL::VARCHAR'} AS event_id,"
            f" {'ts' if 't' in props else 'NULL::TIMESTAMP'} AS ts, {hot.format('true') if touch else 'NULL::BOOLEAN'} AS is_anomaly,"
            f" {hot.format('anomaly_score') if touch else 'NULL::DOUBLE'} AS anomaly_score FROM {table}"
        )

    web = {"Case": _SRC["Case"], "Evidence": _SRC["Evidence"], "BrowserVisit": "'browservisit:'||event_id",
           "Domain": f"'domain:'||case_id||':'||{_WEB_DOMAIN}"}
    spec = [
        ("Case", "HAS_EVIDENCE", "Evidence", ""), ("Evidence", "CONTAINS_EVENT", "Event", "e"),
        ("Event", "OCCURRED_ON", "Host", "e"), ("Event", "INVOLVES_USER", "User", "e"),
        ("Event", "INVOLVES_PROCESS", "Process", "e"), ("User", "EXECUTED", "Process", "et"),
        ("Parent", "SPAWNED", "Process", "eti"), ("Process", "CONNECTED_TO", "IPAddress", "eti"),
        ("IPAddress", "USES_PORT", "Port", ""), ("Process", "RESOLVED", "Domain", "et"),
        ("Domain", "RESOLVES_TO", "IPAddress", ""), ("Process", "MODIFIED_REGISTRY", "RegistryKey", "et"),
        ("Process", "CREATED", "File", "et"), ("Process", "CREATED_SERVICE", "Service", "et"),
    ]
    parts = [edge(*s) for s in spec] + [
        edge("Case", "HAS_EVIDENCE", "Evidence", "", web, "b"), edge("Evidence", "CONTAINS_VISIT", "BrowserVisit", "", web, "b"),
        edge("BrowserVisit", "VISITED_DOMAIN", "Domain", "e", web, "b")]
    edges = "edges AS MATERIALIZED (SELECT * FROM (" + " UNION ".join(parts) + ") WHERE src IS NOT NULL AND dst IS NOT NULL)"

    near = hot.format("anomaly_score")

    def node(label, key, name, table="g", ev="NULL", priv="NULL", near_ok=False, cmd="NULL", pid="NULL", rank="NULL"):
        return (
            f"SELECT {key} AS node_id, '{label}' AS label, case_id, {ev}::VARCHAR AS evidence_id, {name}::VARCHAR AS name, {pid}::BIGINT AS pid,"
            f" {cmd}::VARCHAR AS command_line, {priv}::BOOLEAN AS is_private, {rank}::VARCHAR AS o, {near if near_ok else 'NULL'}::DOUBLE AS sc FROM {table}"
        )

    raw = [
        node("Case", src["Case"], "case_id", "ev"), node("Evidence", src["Evidence"], "evidence_id", "ev", ev="evidence_id", near_ok=True),
        node("Host", src["Host"], "hostname", near_ok=True), node("User", src["User"], "username", near_ok=True),
        node("Process", src["Process"], "process_name", near_ok=True, cmd="command_line", pid="pid",
             rank="strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'|'||event_id"),
        node("Process", parent, "parent_process_name"),
        node("IPAddress", src["IPAddress"], "destination_ip", priv="(destination_ip LIKE '10.%')"),
        node("Port", src["Port"], "destination_port"), node("Domain", src["Domain"], "domain"),
        node("Domain", web["Domain"], _WEB_DOMAIN, "b", near_ok=True), node("RegistryKey", src["RegistryKey"], "registry_key"),
        node("File", src["File"], "file_path"), node("Service", src["Service"], "service_name"),
    ]
    nodes = (
        "nodes AS MATERIALIZED (SELECT node_id, label, case_id, max(evidence_id) AS evidence_id, max(name) AS name, max(pid) AS pid,"
        " arg_max(command_line, o) FILTER (o IS NOT NULL) AS command_line, bool_and(is_private) AS is_private, NULL::TIMESTAMP AS ts,"
        " NULL::VARCHAR AS severity, NULL::VARCHAR AS event_type, NULL::VARCHAR AS source,"
        " CASE WHEN max(sc) IS NOT NULL THEN true END AS is_anomaly, max(sc) AS anomaly_score FROM (" + " UNION ALL ".join(raw) +
        ") WHERE node_id IS NOT NULL GROUP BY 1,2,3 "
        "UNION ALL SELECT 'event:'||event_id, 'Event', case_id, evidence_id, event_type, NULL, NULL, NULL, ts, severity, event_type, source, is_anomaly, anomaly_score FROM g "
        "UNION ALL SELECT 'browservisit:'||event_id, 'BrowserVisit', case_id, evidence_id, coalesce(url,object), NULL, NULL, NULL, ts, severity, event_type, source, is_anomaly, anomaly_score FROM b)"
    )
    return "g AS (SELECT * FROM ev WHERE source<>'browser'), b AS (SELECT * FROM ev WHERE source='browser'), " + edges + ", " + nodes


G = EV + "," + graph_sql() + "\n"
GA = EV + "," + graph_sql("parent_pid") + "\n"
JOINED = """j AS (SELECT e.*, s.name AS s_name, s.severity AS s_sev, s.evidence_id AS s_ev, coalesce(s.is_anomaly,false) OR coalesce(s.anomaly_score>0.5,false) AS s_hot,
  t.name AS d_name, t.severity AS d_sev, t.evidence_id AS d_ev, coalesce(t.is_anomaly,false) OR coalesce(t.anomaly_score>0.5,false) AS d_hot,
  coalesce(e.is_anomaly,false) OR coalesce(e.anomaly_score>0.5,false) AS e_hot,
  coalesce(s.anomaly_score>0.4,false) OR coalesce(t.anomaly_score>0.4,false) AS warm
  FROM edges e JOIN nodes s ON s.node_id=e.src JOIN nodes t ON t.node_id=e.dst)"""
EDGE = "src, src_label, dst, dst_label, rel_type, case_id, evidence_id, event_id, ts, is_anomaly, anomaly_score"
NODE = "node_id, label, case_id, evidence_id, name, pid, command_line, is_private, ts, severity, event_type, source, is_anomaly, anomaly_score"
NODE_COLS = [c.strip() for c in NODE.split(",")]


def built(spark, d, parent_pid="zero"):
    return gr.graph_of(canonical_events(spark, d), parent_pid)


# ---- extraction and construction --------------------------------------------

@query("prj_entities", EV + """, p AS (SELECT *, hostname||':'||pid||':'||process_name AS proc, coalesce(user_domain||chr(92),'')||username AS usr,
  CASE WHEN parent_process_name IS NOT NULL THEN hostname||':'||coalesce(parent_pid,0)||':'||parent_process_name END AS par FROM ev)
  SELECT event_id, type, value, confidence, is_private FROM (
  SELECT event_id, 'Host' AS type, hostname AS value, 1.0::DOUBLE AS confidence, NULL::BOOLEAN AS is_private FROM p
  UNION ALL SELECT event_id, 'User', usr, 1.0, NULL FROM p UNION ALL SELECT event_id, 'Process', proc, 1.0, NULL FROM p
  UNION ALL SELECT event_id, 'Process', par, 0.9, NULL FROM p
  UNION ALL SELECT event_id, 'IPAddress', destination_ip, 1.0, destination_ip LIKE '10.%' FROM p
  UNION ALL SELECT event_id, 'Port', destination_port||':TCP', 1.0, NULL FROM p UNION ALL SELECT event_id, 'Domain', domain, 1.0, NULL FROM p
  UNION ALL SELECT event_id, 'File', file_path, 1.0, NULL FROM p UNION ALL SELECT event_id, 'RegistryKey', registry_key, 1.0, NULL FROM p
  UNION ALL SELECT event_id, 'Service', hostname||':'||service_name, 1.0, NULL FROM p) WHERE value IS NOT NULL""")
def _(spark, d):
    return en.entity_rows(canonical_events(spark, d)).select("event_id", "type", "value", "confidence", "is_private")


@query("prj_relations", EV + """, p AS (SELECT *, hostname||':'||pid||':'||process_name AS proc, coalesce(user_domain||chr(92),'')||username AS usr,
  CASE WHEN parent_process_name IS NOT NULL THEN hostname||':'||coalesce(parent_pid,0)||':'||parent_process_name END AS par,
  destination_port||':TCP' AS port, hostname||':'||service_name AS svc FROM ev)
  SELECT event_id, evidence_id, source_file, rel_type, source, target FROM (
  SELECT event_id, evidence_id, source_file, 'OCCURRED_ON' AS rel_type, event_id AS source, hostname AS target FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, 'EXECUTED', usr, proc FROM p UNION ALL SELECT event_id, evidence_id, source_file, 'SPAWNED', par, proc FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, 'CONNECTED_TO', proc, destination_ip FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, 'USES_PORT', destination_ip, port FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, 'RESOLVED', proc, domain FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, 'RESOLVES_TO', domain, destination_ip FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, CASE WHEN k%2=0 THEN 'CREATED' WHEN k%3=0 THEN 'DELETED' ELSE 'MODIFIED' END, proc, file_path FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, 'MODIFIED_REGISTRY', proc, registry_key FROM p
  UNION ALL SELECT event_id, evidence_id, source_file, 'CREATED_SERVICE', proc, svc FROM p) WHERE source IS NOT NULL AND target IS NOT NULL""")
def _(spark, d):
    from caselens.functions.text import json_path
    k = json_path(F.col("details"), "k").cast("int")
    act = F.when(k % 2 == 0, "File_Created").when(k % 3 == 0, "removed file").otherwise(F.col("action"))
    ev = canonical_events(spark, d).withColumn("action", act)
    return en.relation_rows(ev).select("event_id", "evidence_id", "source_file", "rel_type", "source", "target")


@query("agg_extract_totals", EV + """SELECT case_id, evidence_id, count(*) AS events, CAST(sum(2 + u + par + 2*ip + dom + fil + reg + svc) AS BIGINT) AS entities,
  CAST(sum(1 + u + par + 2*ip + 2*dom + fil + reg + svc) AS BIGINT) AS relationships FROM (SELECT case_id, evidence_id,
  (username IS NOT NULL)::INT AS u, (parent_process_name IS NOT NULL)::INT AS par, (destination_ip IS NOT NULL)::INT AS ip, (domain IS NOT NULL)::INT AS dom,
  (file_path IS NOT NULL)::INT AS fil, (registry_key IS NOT NULL)::INT AS reg, (service_name IS NOT NULL)::INT AS svc FROM ev) GROUP BY 1,2""")
def _(spark, d):
    return ag.extract_totals(en.with_entities(canonical_events(spark, d)))


@query("prj_graph_flat", G + """SELECT event_id, hostname AS g_host, username AS g_user, coalesce(user_domain,'WORKGROUP') AS g_user_domain,
  process_name AS g_process, pid AS g_pid, command_line AS g_command, parent_process_name AS g_parent, destination_ip AS g_ip,
  destination_port AS g_port, domain AS g_domain, registry_key AS g_registry, file_path AS g_file, service_name AS g_service FROM g""")
def _(spark, d):
    _, generic = gr.route(canonical_events(spark, d))
    return gr.flatten(generic).select(
        "event_id", "g_host", "g_user", "g_user_domain", "g_process", "g_pid", "g_command", "g_parent", "g_ip", "g_port",
        "g_domain", "g_registry", "g_file", "g_service")


@query("prj_browser_flat", G + f"SELECT event_id, coalesce(url,object) AS g_url, coalesce(d_title,'') AS g_title, 1 AS g_visit_count, {_WEB_DOMAIN} AS g_domain FROM b")
def _(spark, d):
    web, _g = gr.route(canonical_events(spark, d))
    return gr.flatten_browser(web).select("event_id", "g_url", "g_title", "g_visit_count", "g_domain")


@query("prj_node_key", G + "SELECT node_id, regexp_replace(node_id, '^[a-z]+:', '') AS raw_id, substring(name,1,80) AS name FROM nodes")
def _(spark, d):
    n, _e = built(spark, d)
    return n.select("node_id", gr.raw_key(F.col("node_id")).alias("raw_id"), F.substring("name", 1, 80).alias("name"))


@query("gr_route", EV + "SELECT CASE WHEN source='browser' THEN 'browser' ELSE 'generic' END AS model, case_id, count(*) AS n FROM ev GROUP BY 1, 2")
def _(spark, d):
    web, generic = gr.route(canonical_events(spark, d))
    rows = web.select("case_id", F.lit("browser").alias("model")).unionByName(generic.select("case_id", F.lit("generic").alias("model")))
    return rows.groupBy("model", "case_id").agg(F.count("*").alias("n"))


@query("gr_build_generic", G + f"SELECT {EDGE} FROM edges WHERE rel_type NOT IN ('CONTAINS_VISIT','VISITED_DOMAIN')")
def _(spark, d):
    return gr.edges_of(canonical_events(spark, d)).filter("rel_type not in ('CONTAINS_VISIT', 'VISITED_DOMAIN')")


@query("gr_build_browser", G + f"SELECT {EDGE} FROM edges WHERE rel_type IN ('CONTAINS_VISIT','VISITED_DOMAIN')")
def _(spark, d):
    return gr.edges_of(canonical_events(spark, d)).filter("rel_type in ('CONTAINS_VISIT', 'VISITED_DOMAIN')")


@query("gr_nodes", G + f"SELECT {NODE} FROM nodes")
def _(spark, d):
    return built(spark, d)[0].select(*NODE_COLS)


@query("set_merge", G + f"SELECT 'node' AS kind, label AS t, count(*) AS n, count(command_line) AS filled FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*), count(ts) FROM edges GROUP BY 2")
def _(spark, d):
    n, e = built(spark, d)
    n2, e2 = gr.upsert_nodes(n, n), gr.upsert_edges(e, e)
    return n2.groupBy(F.lit("node").alias("kind"), F.col("label").alias("t")).agg(
        F.count("*").alias("n"), F.count("command_line").alias("filled")
    ).unionByName(e2.groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("t")).agg(
        F.count("*").alias("n"), F.count("ts").alias("filled")))


@query("set_batches", G + f"SELECT {EDGE} FROM edges")
def _(spark, d):
    ev = canonical_events(spark, d)
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    return gr.upsert_edges(gr.edges_of(ev.filter(half)), gr.edges_of(ev.filter(~half)))


@query("agg_propagate", G + f"SELECT node_id, label, is_anomaly, anomaly_score FROM nodes WHERE label NOT IN ('Event','BrowserVisit')")
def _(spark, d):
    ev = canonical_events(spark, d)
    blank = ev.withColumn("is_anomaly", F.lit(False)).withColumn("anomaly_score", F.lit(0.0))
    scores = ev.select("event_id", F.col("is_anomaly").alias("flag"), F.col("anomaly_score").alias("score"))
    n, _e = gr.propagate(gr.nodes_of(blank), gr.edges_of(blank), scores)
    return n.filter(~F.col("label").isin(gr.EVENT_LABELS)).select("node_id", "label", "is_anomaly", "anomaly_score")


# ---- aggregates over the graph ----------------------------------------------

DEG_SQL = """deg AS (SELECT case_id, node_id, label, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS total_degree FROM (
  SELECT case_id, src AS node_id, src_label AS label, 1 AS o, 0 AS i FROM edges UNION ALL SELECT case_id, dst, dst_label, 0, 1 FROM edges) GROUP BY 1,2,3),
  degtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY total_degree DESC, node_id) AS rank FROM deg) WHERE rank<=10)"""
HOT_SQL = """hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY anomaly_edge_count DESC, node_id) AS rank FROM (
  SELECT case_id, src AS node_id, src_label AS label, count(*) AS anomaly_edge_count FROM edges WHERE is_anomaly GROUP BY 1,2,3)) WHERE rank<=10)"""
ACT_SQL = """act AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, rel_type) AS rank FROM (
  SELECT case_id, rel_type, count(*) AS n FROM edges GROUP BY 1,2)) WHERE rank<=15)"""


@query("agg_degree", G + "," + DEG_SQL + " SELECT * FROM degtop")
def _(spark, d):
    return ag.degree(built(spark, d)[1], 10)


@query("agg_hotspots", G + "," + HOT_SQL + " SELECT * FROM hot")
def _(spark, d):
    return ag.hotspots(built(spark, d)[1])


@query("agg_types", G + "SELECT case_id, label, count(*) AS n FROM nodes GROUP BY 1,2")
def _(spark, d):
    return ag.type_counts(built(spark, d)[0])


@query("agg_actions", G + "," + ACT_SQL + " SELECT * FROM act")
def _(spark, d):
    return ag.action_counts(built(spark, d)[1])


@query("agg_summary", G + "," + DEG_SQL + "," + HOT_SQL + "," + ACT_SQL + """
  SELECT case_id, 'degree' AS metric, node_id AS key, total_degree AS value FROM degtop UNION ALL SELECT case_id, 'hotspot', node_id, anomaly_edge_count FROM hot
  UNION ALL SELECT case_id, 'type', label, count(*) FROM nodes GROUP BY 1,3 UNION ALL SELECT case_id, 'action', rel_type, n FROM act""")
def _(spark, d):
    return ag.graph_summary(*built(spark, d))


@query("agg_edges", G + """SELECT case_id, src, dst, rel_type, count(*) AS edge_count, bool_or(coalesce(is_anomaly,false)) AS is_anomaly,
  max(anomaly_score) AS anomaly_score FROM edges GROUP BY 1,2,3,4""")
def _(spark, d):
    return ag.collapse_edges(built(spark, d)[1]).select("case_id", "src", "dst", "rel_type", "edge_count", "is_anomaly", "anomaly_score")


@query("agg_labels", G + """SELECT 'node' AS kind, label AS key, count(*) AS n, count(DISTINCT case_id) AS cases, count(*)-count(case_id) AS without_case FROM nodes GROUP BY 2
  UNION ALL SELECT 'edge', rel_type, count(*), count(DISTINCT case_id), count(*)-count(case_id) FROM edges GROUP BY 2""")
def _(spark, d):
    return ag.labels(*built(spark, d))


@query("agg_reconcile", G + """SELECT case_id, event_rows, graph_nodes, graph_edges, 'ok' AS verdict FROM (SELECT case_id, count(*) AS event_rows FROM ev GROUP BY 1)
  JOIN (SELECT case_id, count(*) AS graph_nodes FROM nodes GROUP BY 1) USING (case_id) JOIN (SELECT case_id, count(*) AS graph_edges FROM edges GROUP BY 1) USING (case_id)""")
def _(spark, d):
    n, e = built(spark, d)
    return ag.reconcile(canonical_events(spark, d), n, e)


@query("jn_orphan", G + """, e2 AS (SELECT * FROM edges WHERE rel_type NOT IN ('CONTAINS_VISIT','CREATED','CREATED_SERVICE'))
  SELECT node_id, label FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE src=node_id OR dst=node_id)""")
def _(spark, d):
    n, e = built(spark, d)
    e = e.filter("rel_type not in ('CONTAINS_VISIT', 'CREATED', 'CREATED_SERVICE')")
    return jn.orphan_nodes(n, e).select("node_id", "label")


# ---- filters and views -------------------------------------------------------

BENIGN_SQL = "('" + "','".join(vw.BENIGN) + "')"


@query("flt_sev_floor", G + "," + JOINED + " SELECT src, dst, rel_type FROM j WHERE s_sev IN ('high','critical') OR d_sev IN ('high','critical')")
def _(spark, d):
    n, e = built(spark, d)
    return vw.case_graph(n, e).filter(vw.severity_at_least("high")).select("src", "dst", "rel_type")


@query("flt_anom_edges", G + "," + JOINED + " SELECT src, dst, rel_type, ts FROM j WHERE e_hot OR s_hot OR d_hot")
def _(spark, d):
    n, e = built(spark, d)
    return vw.case_graph(n, e, anomaly_only=True).select("src", "dst", "rel_type", "ts")


@query("flt_benign", G + "," + JOINED + f" SELECT src, dst, rel_type, ts FROM j WHERE NOT (lower(s_name) IN {BENIGN_SQL} OR lower(d_name) IN {BENIGN_SQL})")
def _(spark, d):
    n, e = built(spark, d)
    return vw.case_graph(n, e).filter(~vw.touches_benign()).select("src", "dst", "rel_type", "ts")


@query("flt_graph_search", G + "," + JOINED + """ SELECT src, dst, rel_type, ts FROM j WHERE (src_label IN ('Process','User','Host','IPAddress','Domain','RegistryKey','File') AND contains(lower(s_name),'cmd.'))
  OR (dst_label IN ('Process','User','Host','IPAddress','Domain','RegistryKey','File') AND contains(lower(d_name),'cmd.'))""")
def _(spark, d):
    n, e = built(spark, d)
    return vw.case_graph(n, e).filter(vw.label_matches("CMD.")).select("src", "dst", "rel_type", "ts")


@query("flt_evidence_edges", G + "," + JOINED + " SELECT src, dst, rel_type, ts FROM j WHERE evidence_id='ev_2_3' OR s_ev='ev_2_3' OR d_ev='ev_2_3'")
def _(spark, d):
    n, e = built(spark, d)
    return vw.case_graph(n, e, evidence_id="ev_2_3").select("src", "dst", "rel_type", "ts")


@query("gr_case", G + "," + JOINED + " SELECT src, dst, rel_type, ts, event_id, s_name, d_name, e_hot OR s_hot OR d_hot AS hot FROM j")
def _(spark, d):
    n, e = built(spark, d)
    return vw.case_graph(n, e).select("src", "dst", "rel_type", "ts", "event_id", "s_name", "d_name", vw.end_anomalous().alias("hot"))


def _in(values):
    return "('" + "','".join(values) + "')"


_VIEW_WHERE = {
    "entity": "src_label NOT IN ('Event','Case') AND dst_label NOT IN ('Event','Case')",
    "attack_path": f"(e_hot OR s_hot OR d_hot OR warm OR lower(s_name) IN {_in(vw.ATTACK_IMAGES)} OR lower(d_name) IN {_in(vw.ATTACK_IMAGES)})",
    "ioc": "(e_hot OR s_hot OR d_hot)",
    "registry": "(src_label='RegistryKey' OR dst_label='RegistryKey')",
    "auth": "(src_label IN ('User','Host') OR dst_label IN ('User','Host'))",
}


def _view_sql(v):
    where = [_VIEW_WHERE.get(v, "true")]
    if v in vw.VIEW_RELATIONS:
        where.append(f"rel_type IN {_in(vw.VIEW_RELATIONS[v])}")
    return (f"SELECT '{v}' AS view, case_id, src, dst, rel_type, count(*) AS edge_count, substring(max(s_name),1,80) AS src_name, substring(max(d_name),1,80) AS dst_name, "
            f"bool_or(coalesce(is_anomaly,false)) AS is_anomaly FROM j WHERE {' AND '.join(where)} GROUP BY case_id, src, dst, rel_type")


@query("gr_views", G + "," + JOINED + " " + " UNION ALL ".join(_view_sql(v) for v in vw.VIEWS))
def _(spark, d):
    return vw.all_views(*built(spark, d)).select("view", "case_id", "src", "dst", "rel_type", "edge_count", "src_name", "dst_name", "is_anomaly")


RISK_SQL = """, r AS (SELECT *, lower(coalesce(name,'')) AS n, coalesce(is_anomaly,false) OR coalesce(anomaly_score,0)>0.75 AS top FROM nodes),
  r2 AS (SELECT *, CASE label WHEN 'Process' THEN CASE WHEN contains(n,'powershell') THEN 'T1059.001' WHEN contains(n,'cmd') THEN 'T1059.003' WHEN contains(n,'wmic') THEN 'T1047'
    WHEN contains(n,'schtasks.exe') OR contains(n,'at.exe') THEN 'T1053.005' WHEN contains(n,'mshta.exe') OR contains(n,'regsvr32.exe') OR contains(n,'rundll32.exe') THEN 'T1218'
    WHEN contains(n,'certutil.exe') OR contains(n,'bitsadmin.exe') THEN 'T1105' WHEN contains(n,'reg.exe') THEN 'T1112' WHEN contains(n,'net.exe') OR contains(n,'net1.exe') THEN 'T1087' END
   WHEN 'IPAddress' THEN CASE WHEN NOT is_private THEN 'T1071' END WHEN 'Domain' THEN 'T1568' WHEN 'RegistryKey' THEN CASE WHEN contains(n,'run') OR contains(n,'winlogon') OR contains(n,'startup') THEN 'T1547.001' END END AS tech FROM r),
  r3 AS (SELECT *, CASE tech WHEN 'T1059.001' THEN 'high' WHEN 'T1059.003' THEN 'medium' WHEN 'T1047' THEN 'high' WHEN 'T1053.005' THEN 'high' WHEN 'T1218' THEN 'critical' WHEN 'T1105' THEN 'critical'
    WHEN 'T1112' THEN 'medium' WHEN 'T1087' THEN 'medium' WHEN 'T1071' THEN 'medium' WHEN 'T1568' THEN 'info' WHEN 'T1547.001' THEN 'high' ELSE 'low' END AS lv FROM r2)"""
RISK_LEVEL = "CASE WHEN top THEN 'critical' WHEN coalesce(anomaly_score,0)>0.5 AND lv NOT IN ('critical','high') THEN 'high' ELSE lv END AS risk_level"


@query("prj_node_risk", G + RISK_SQL + f"""
  SELECT node_id, tech AS technique_id, {RISK_LEVEL},
  top OR coalesce(anomaly_score,0)>0.5 OR (tech IS NOT NULL AND label<>'Domain') AS suspicious FROM r3""")
def _(spark, d):
    return vw.with_risk(built(spark, d)[0]).select("node_id", "technique_id", "risk_level", "suspicious")


# ---- traversal -----------------------------------------------------------------

ADJ = "adj AS MATERIALIZED (SELECT src AS u, dst AS v FROM edges WHERE src<>dst UNION SELECT dst, src FROM edges WHERE src<>dst)"


@query("gr_neighbors", G.replace("WITH", "WITH RECURSIVE", 1) + "," + ADJ + """, seeds AS (SELECT 'event:'||arg_min(event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||event_id) AS seed FROM g GROUP BY case_id),
  w AS (SELECT seed, seed AS node_id, 0 AS hops FROM seeds UNION SELECT seed, v, hops+1 FROM w JOIN adj ON u=node_id WHERE hops<3)
  SELECT seed, node_id, min(hops) AS hops FROM w GROUP BY 1,2 HAVING min(hops)>0""")
def _(spark, d):
    ev = canonical_events(spark, d).filter(~gr.is_browser())
    first = ev.groupBy("case_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("e"))
    seeds = first.select(gr.node_key("Event", F.col("e")).alias("node_id"))
    return tr.neighbors(gr.edges_of(canonical_events(spark, d)), seeds, 3)


SHORT_PAIRS = """pairs AS (SELECT case_id AS pair_id, min(node_id) FILTER (label='Port') AS source, max(node_id) FILTER (label='Service') AS target FROM nodes GROUP BY 1)"""


@query("gr_shortest", G.replace("WITH", "WITH RECURSIVE", 1) + "," + ADJ + "," + SHORT_PAIRS + """,
  w AS (SELECT pair_id, source AS node_id, 0 AS hops FROM pairs UNION SELECT pair_id, v, hops+1 FROM w JOIN adj ON u=node_id WHERE hops<9),
  dist AS MATERIALIZED (SELECT pair_id, node_id, min(hops) AS hops FROM w GROUP BY 1,2),
  via AS (SELECT a.pair_id, a.node_id, a.hops, min(b.node_id) AS via FROM dist a JOIN adj ON v=a.node_id JOIN dist b ON b.pair_id=a.pair_id AND b.node_id=u AND b.hops=a.hops-1 GROUP BY 1,2,3),
  back AS (SELECT p.pair_id, target AS node_id, target AS path, hops, hops AS left_hops FROM pairs p JOIN dist ON dist.pair_id=p.pair_id AND dist.node_id=p.target
    UNION ALL SELECT back.pair_id, via.via, via.via||' > '||path, back.hops, left_hops-1 FROM back JOIN via ON via.pair_id=back.pair_id AND via.node_id=back.node_id WHERE left_hops>0)
  SELECT pair_id, hops, path FROM back WHERE left_hops=0""")
def _(spark, d):
    n, e = built(spark, d)
    pairs = n.groupBy(F.col("case_id").alias("pair_id")).agg(
        F.min(F.when(F.col("label") == "Port", F.col("node_id"))).alias("source"),
        F.max(F.when(F.col("label") == "Service", F.col("node_id"))).alias("target"))
    out = tr.shortest_paths(e, pairs).filter("reached")
    return out.select("pair_id", F.col("hops").cast("int").alias("hops"), F.array_join("path", " > ").alias("path"))


CHAIN_SQL = """sp AS MATERIALIZED (SELECT case_id, src, dst, s_name, d_name, count(*) AS m FROM j WHERE rel_type='SPAWNED' GROUP BY ALL),
  roots AS (SELECT * FROM sp WHERE src NOT IN (SELECT dst FROM sp)),
  c1 AS (SELECT case_id, [src,dst] AS path, [s_name,d_name] AS names, CAST(m AS BIGINT) AS n_paths, dst AS last, 1 AS depth FROM roots),
  c2 AS (SELECT c.case_id, list_append(path,dst) AS path, list_append(names,d_name) AS names, n_paths*m AS n_paths, dst AS last, 2 AS depth FROM c1 c JOIN sp ON sp.src=c.last),
  c3 AS (SELECT c.case_id, list_append(path,dst) AS path, list_append(names,d_name) AS names, n_paths*m AS n_paths, dst AS last, 3 AS depth FROM c2 c JOIN sp ON sp.src=c.last),
  c4 AS (SELECT c.case_id, list_append(path,dst) AS path, list_append(names,d_name) AS names, n_paths*m AS n_paths, dst AS last, 4 AS depth FROM c3 c JOIN sp ON sp.src=c.last),
  ch AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4)"""


@query("gr_chains", GA + "," + JOINED + "," + CHAIN_SQL + " SELECT case_id, array_to_string(path,' > ') AS path, array_to_string(names,' -> ') AS chain, depth, n_paths FROM ch")
def _(spark, d):
    n, e = built(spark, d, "actual")
    return tr.chains(e, n.filter("label = 'Process'")).select(
        "case_id", F.array_join("path", " > ").alias("path"), F.array_join("names", " -> ").alias("chain"), "depth", "n_paths")


@query("gr_attack_trace", G.replace("WITH", "WITH RECURSIVE", 1) + "," + JOINED.replace("j AS (", "j AS MATERIALIZED (", 1).rstrip() + RISK_SQL + f""", net AS MATERIALIZED ({_view_sql("network")}),
  adj AS MATERIALIZED (SELECT src AS u, dst AS v FROM net WHERE src<>dst UNION SELECT dst, src FROM net WHERE src<>dst), ends AS (SELECT src AS node_id FROM net UNION SELECT dst FROM net),
  lev AS (SELECT case_id, node_id, ts, {RISK_LEVEL} FROM r3), fts AS (SELECT node_id, min(ts) AS first_ts FROM (SELECT src AS node_id, ts FROM edges UNION ALL SELECT dst, ts FROM edges) WHERE ts IS NOT NULL GROUP BY 1),
  sus AS MATERIALIZED (SELECT case_id, node_id, coalesce(ts, first_ts) AS ts FROM lev JOIN ends USING (node_id) LEFT JOIN fts USING (node_id) WHERE risk_level='critical' AND coalesce(ts, first_ts) IS NOT NULL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, node_id) AS pos FROM sus),
  pairs AS MATERIALIZED (SELECT a.case_id||'#'||a.pos AS pair_id, a.case_id, a.node_id AS source, b.node_id AS target FROM rk a JOIN rk b ON b.case_id=a.case_id AND b.pos=a.pos+1),
  w AS (SELECT pair_id, source AS node_id, 0 AS hops FROM pairs UNION SELECT pair_id, v, hops+1 FROM w JOIN adj ON u=node_id WHERE hops<12),
  dist AS MATERIALIZED (SELECT pair_id, node_id, min(hops) AS hops FROM w GROUP BY 1,2),
  via AS MATERIALIZED (SELECT a.pair_id, a.node_id, min(b.node_id) AS via FROM dist a JOIN adj ON v=a.node_id JOIN dist b ON b.pair_id=a.pair_id AND b.node_id=u AND b.hops=a.hops-1 GROUP BY 1,2),
  back AS (SELECT p.pair_id, p.case_id, target AS node_id, hops AS left_hops FROM pairs p JOIN dist ON dist.pair_id=p.pair_id AND dist.node_id=p.target
    UNION ALL SELECT back.pair_id, back.case_id, via.via, left_hops-1 FROM back JOIN via ON via.pair_id=back.pair_id AND via.node_id=back.node_id WHERE left_hops>0)
  SELECT case_id, node_id FROM back UNION SELECT case_id, node_id FROM sus
  UNION SELECT s.case_id, v FROM sus s JOIN adj ON u=s.node_id WHERE s.case_id NOT IN (SELECT case_id FROM back)""")
def _(spark, d):
    from caselens.session import materialize
    n, e = built(spark, d)
    rels = vw.VIEW_RELATIONS["network"]
    n = materialize(n.filter(F.col("label").isin(gr.labels_of(rels))), "graph")  # no other node is an end of the view's edges
    e = materialize(e.filter(F.col("rel_type").isin(rels) | F.col("ts").isNotNull()), "graph")
    net = materialize(vw.view(n, e, "network").select("src", "dst"), "network")
    risky = vw.view_nodes(n, net).filter("risk_level = 'critical'")
    when = e.filter("ts is not null").select(F.explode(F.array("src", "dst")).alias("node_id"), "ts").groupBy("node_id").agg(F.min("ts").alias("first_ts"))
    sus = risky.join(when, "node_id", "left").select("case_id", "node_id", F.coalesce("ts", "first_ts").alias("ts"))
    return tr.attack_trace(net, sus.filter("ts is not null"))


@query("gr_delete", G + """, gone AS (SELECT node_id FROM nodes WHERE label IN ('Event','BrowserVisit','Evidence') AND evidence_id IN ('ev_1_1','ev_4_0'))
  SELECT 'node' AS kind, node_id AS a, '' AS b, '' AS t FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone)
  UNION ALL SELECT 'edge', src, dst, rel_type FROM edges WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)""")
def _(spark, d):
    from caselens.session import materialize
    n, e = (materialize(x, "graph") for x in built(spark, d))
    doomed = n.filter("label = 'Evidence' and evidence_id in ('ev_1_1', 'ev_4_0')").select("case_id", "evidence_id")
    n2, e2 = gr.delete_evidence(n, e, doomed)
    blank = F.lit("")
    return n2.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), blank.alias("b"), blank.alias("t")).unionByName(
        e2.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rel_type").alias("t")))


@query("gr_clear", G + "SELECT 'node' AS kind, label AS t, count(*) AS n FROM nodes WHERE case_id<>'case_6' GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges WHERE case_id<>'case_6' GROUP BY 2")
def _(spark, d):
    n, e = gr.clear_case(*built(spark, d), "case_6")
    return n.groupBy(F.lit("node").alias("kind"), F.col("label").alias("t")).agg(F.count("*").alias("n")).unionByName(
        e.groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("t")).agg(F.count("*").alias("n")))


# ---- rules -----------------------------------------------------------------------

FIND = "case_id, correlation_id, rule, score, severity, source, target, explanation, matches, reasons, chain"
F_COLS = [f"array_join({c}, ' | ') AS {c}" if c in ("reasons", "chain") else c for c in co.FINDING_COLUMNS]


def _sev(score, lo="'high'"):
    return f"CASE WHEN {score}>=80 THEN 'critical' ELSE {lo} END"


ATTACK_ROWS = """ar AS (SELECT ex.case_id, ex.p, us.name AS username, pr.name AS process_name, pr.command_line, ip.name AS address, pt.name AS port, CAST(ex.m*c.m AS BIGINT) AS n_rows FROM
  (SELECT case_id, src AS u, dst AS p, count(*) AS m FROM edges WHERE rel_type='EXECUTED' GROUP BY 1,2,3) ex JOIN
  (SELECT src AS p, dst AS ip, count(*) AS m FROM edges WHERE rel_type='CONNECTED_TO' GROUP BY 1,2) c ON c.p=ex.p
  JOIN nodes ip ON ip.node_id=c.ip AND NOT ip.is_private JOIN nodes us ON us.node_id=ex.u JOIN nodes pr ON pr.node_id=ex.p
  LEFT JOIN (SELECT src, dst FROM edges WHERE rel_type='USES_PORT') up ON up.src=c.ip LEFT JOIN nodes pt ON pt.node_id=up.dst)"""
CROSS_ROWS = """pk AS (SELECT case_id, destination_ip AS address, evidence_id, count(*) AS n FROM ev WHERE source='pcap' AND destination_ip IS NOT NULL GROUP BY 1,2,3),
  cr AS (SELECT l.case_id, l.evidence_id, l.process_name, l.address, CAST(sum(l.n1*pk.n) AS BIGINT) AS n_pairs FROM (
   SELECT i.case_id, i.evidence_id, p.name AS process_name, a.name AS address, sum(i.n*c.m) AS n1 FROM
   (SELECT case_id, evidence_id, dst AS p, count(*) AS n FROM edges WHERE rel_type='INVOLVES_PROCESS' GROUP BY 1,2,3) i
   JOIN (SELECT src, dst, count(*) AS m FROM edges WHERE rel_type='CONNECTED_TO' GROUP BY 1,2) c ON c.src=i.p
   JOIN nodes p ON p.node_id=i.p JOIN nodes a ON a.node_id=c.dst GROUP BY 1,2,3,4) l
   JOIN pk ON pk.case_id=l.case_id AND pk.address=l.address AND pk.evidence_id<>l.evidence_id GROUP BY 1,2,3,4)"""
REG_ROWS = """rr AS (SELECT e.case_id, p.name AS process_name, r.name AS reg_path, count(*) AS n_rows FROM edges e JOIN nodes p ON p.node_id=e.src JOIN nodes r ON r.node_id=e.dst
  WHERE rel_type='MODIFIED_REGISTRY' GROUP BY 1, e.src, 2, 3)"""
DOM_ROWS = """dr AS (SELECT d.case_id, d.name AS domain_name, p.name AS process_name, coalesce(e.m, 1) AS n_rows FROM nodes d
  LEFT JOIN (SELECT src, dst, count(*) AS m FROM edges WHERE rel_type='RESOLVED' GROUP BY 1,2) e ON e.dst=d.node_id LEFT JOIN nodes p ON p.node_id=e.src WHERE d.label='Domain')"""
RULES_SQL = JOINED + "," + CHAIN_SQL + "," + ATTACK_ROWS + "," + CROSS_ROWS + "," + REG_ROWS + "," + DOM_ROWS + f""",
 f0 AS (SELECT case_id, 'proc_chain_'||substring(md5(case_id||line),1,10) AS correlation_id, 'PROCESS_CHAIN' AS rule, score, CASE WHEN score>=80 THEN 'critical' WHEN score>=60 THEN 'high' ELSE 'medium' END AS severity,
   source, target, 'Processes started one another over '||depth||' steps, '||line AS explanation, matches,
   'steps: '||depth||CASE WHEN shell THEN ' | script interpreter in the line' ELSE '' END AS reasons, replace(line,' -> ',' | ') AS chain FROM (
   SELECT case_id, line, depth, any_value(len(list_filter(names, lambda x: lower(x) IN ('powershell.exe','cmd.exe','wscript.exe','mshta.exe'))))>0 AS shell, any_value(names[1]) AS source, any_value(names[-1]) AS target, CAST(sum(n_paths) AS BIGINT) AS matches,
   least(100, least(100, 40+15*depth) + CASE WHEN any_value(len(list_filter(names, lambda x: lower(x) IN ('powershell.exe','cmd.exe','wscript.exe','mshta.exe'))))>0 THEN 20 ELSE 0 END) AS score
   FROM (SELECT *, array_to_string(names,' -> ') AS line FROM ch) GROUP BY 1,2,3)),
 f1 AS (SELECT case_id, 'attack_path_'||substring(md5(case_id||substring(p,9)||address),1,10) AS correlation_id, 'ATTACK_PATH' AS rule, score, {_sev('score')} AS severity, usr||' ('||process_name||')' AS source,
   address||':'||port AS target, process_name||', run by '||usr||', reached the public address '||address||':'||port AS explanation, matches,
   'public address'||CASE WHEN score=95 THEN ' | PowerShell or encoded command' ELSE '' END AS reasons, usr||' | '||process_name||' | '||address||':'||port AS chain FROM (
   SELECT case_id, p, process_name, address, min(username) AS usr, min(coalesce(port,'?')) AS port, CAST(sum(n_rows) AS BIGINT) AS matches,
   CASE WHEN contains(lower(process_name),'powershell') OR contains(lower(any_value(coalesce(command_line,''))),'-enc') THEN 95 ELSE 75 END AS score FROM ar GROUP BY 1,2,3,4)),
 f2 AS (SELECT case_id, 'cross_ev_'||substring(md5(case_id||evidence_id||address),1,10) AS correlation_id, 'CROSS_EVIDENCE_CORRELATION' AS rule, 85 AS score, 'high' AS severity, min(process_name) AS source, address AS target,
   min(process_name)||' and a capture in another file both show '||address AS explanation, CAST(sum(n_pairs) AS BIGINT) AS matches,
   'address seen in two evidence files' AS reasons, min(process_name)||' | '||address AS chain FROM cr GROUP BY case_id, evidence_id, address),
 f3 AS (SELECT case_id, 'lolbin_'||substring(md5(case_id||name||substring(node_id,9)),1,10) AS correlation_id, 'SUSPICIOUS_LOLBIN_EXECUTION' AS rule, score, {_sev('score')} AS severity, name AS source, substring(cmd,1,80) AS target,
   name||' is a system tool open to misuse; it ran '||cmd AS explanation, CAST(1 AS BIGINT) AS matches,
   'system tool open to misuse'||CASE WHEN score=90 THEN ' | encoded or hidden command' ELSE '' END AS reasons, name AS chain FROM (
   SELECT *, coalesce(command_line,name) AS cmd, CASE WHEN regexp_matches(lower(coalesce(command_line,name)),'-enc|-nop|downloadstring') THEN 90 ELSE 70 END AS score FROM nodes
   WHERE label='Process' AND regexp_matches(lower(name),'powershell|cmd[.]exe|mshta|certutil|rundll32|wscript|cscript|regsvr32'))),
 f4 AS (SELECT case_id, 'reg_persist_'||substring(md5(case_id||reg_path),1,10) AS correlation_id, 'REGISTRY_RUN_KEY_PERSISTENCE' AS rule, CASE WHEN regexp_matches(lower(reg_path),'run|services') THEN 85 ELSE 65 END AS score,
   CASE WHEN regexp_matches(lower(reg_path),'run|services') THEN 'critical' ELSE 'high' END AS severity, min(process_name) AS source, reg_path AS target,
   min(process_name)||' wrote the registry key '||reg_path AS explanation, CAST(sum(n_rows) AS BIGINT) AS matches,
   'registry change'||CASE WHEN regexp_matches(lower(reg_path),'run|services') THEN ' | key of an autostart or a service' ELSE '' END AS reasons, min(process_name)||' | '||reg_path AS chain FROM rr GROUP BY case_id, reg_path),
 f5 AS (SELECT case_id, 'dom_c2_'||substring(md5(case_id||domain_name||proc),1,10) AS correlation_id, 'DOMAIN_RESOLUTION' AS rule, 60 AS score, 'medium' AS severity, proc AS source, domain_name AS target,
   proc||' looked up '||domain_name AS explanation, CAST(sum(n_rows) AS BIGINT) AS matches, 'name lookup' AS reasons, proc||' | '||domain_name AS chain FROM (SELECT *, coalesce(process_name,'Network Service') AS proc FROM dr) GROUP BY case_id, domain_name, proc),
 allf AS (SELECT {FIND} FROM f0 UNION ALL SELECT {FIND} FROM f1 UNION ALL SELECT {FIND} FROM f2 UNION ALL SELECT {FIND} FROM f3 UNION ALL SELECT {FIND} FROM f4 UNION ALL SELECT {FIND} FROM f5)"""
R = GA + "," + RULES_SQL + "\n"


@query("jn_attack", R + "SELECT case_id, p, username, address, port, n_rows FROM ar")
def _(spark, d):
    return co.attack_rows(*built(spark, d, "actual")).select("case_id", "p", "username", "address", "port", "n_rows")


@query("jn_cross", R + "SELECT * FROM cr")
def _(spark, d):
    return co.cross_rows(*built(spark, d, "actual"), canonical_events(spark, d))


@query("jn_registry", R + "SELECT * FROM rr")
def _(spark, d):
    return co.registry_rows(*built(spark, d, "actual"))


@query("jn_domain", R + "SELECT * FROM dr")
def _(spark, d):
    return co.domain_rows(*built(spark, d, "actual"))


def _rule(name, cte, fn, with_events=False):
    @query(name, R + f"SELECT {FIND} FROM {cte}")
    def _(spark, d):
        n, e = built(spark, d, "actual")
        return (fn(n, e, canonical_events(spark, d)) if with_events else fn(n, e)).selectExpr(*F_COLS)


_rule("cor_chain", "f0", co.process_chains)
_rule("cor_attack", "f1", co.attack_paths)
_rule("cor_cross", "f2", co.cross_evidence, True)
_rule("cor_lolbin", "f3", co.lolbins)
_rule("cor_registry", "f4", co.registry_persistence)
_rule("cor_domain", "f5", co.domain_resolutions)


def findings(spark, d):
    n, e = built(spark, d, "actual")
    return co.all_findings(n, e, canonical_events(spark, d))


@query("cor_all", R + f"SELECT {FIND} FROM allf")
def _(spark, d):
    return findings(spark, d).selectExpr(*F_COLS)


@query("set_findings", R + f"SELECT {FIND} FROM allf")
def _(spark, d):
    rows = findings(spark, d).withColumn("rule_no", F.lit(0))
    again = rows.withColumn("rule_no", F.lit(1)).withColumn("score", F.lit(0))
    return co.dedupe_findings(rows.unionByName(again)).selectExpr(*F_COLS)


@query("agg_rules", R + "SELECT case_id, rule, count(*) AS n, max(score) AS max_score FROM allf GROUP BY 1,2")
def _(spark, d):
    return ag.rule_counts(findings(spark, d))


@query("srt_rule_cap", R + """SELECT case_id, rule, correlation_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, rule ORDER BY score DESC, correlation_id) AS rank FROM allf) WHERE rank<=50""")
def _(spark, d):
    from caselens.operators.ordered import top_n
    return top_n(findings(spark, d), ["case_id", "rule"], [F.desc("score"), F.asc("correlation_id")], 50).select("case_id", "rule", "correlation_id", "rank")


TEMPORAL_SQL = """tg AS (SELECT n.case_id, min(v.ts) AS target_ts FROM edges e JOIN nodes n ON n.node_id=e.dst AND contains(n.name,'certutil') JOIN nodes v ON v.node_id=e.src WHERE rel_type='INVOLVES_PROCESS' GROUP BY 1)"""


@query("cor_temporal", G + "," + TEMPORAL_SQL + """ SELECT v.case_id, substring(v.node_id,7) AS event_id, v.event_type, v.ts, v.severity, v.is_anomaly, e.dst_label AS target_type, e.rel_type
  FROM nodes v JOIN tg ON tg.case_id=v.case_id AND abs(epoch_us(v.ts)-epoch_us(tg.target_ts)) <= 1800000000 JOIN edges e ON e.src=v.node_id WHERE v.label='Event'""")
def _(spark, d):
    return co.temporal_window_of_events(canonical_events(spark, d), "certutil", 30)


@query("jn_interval", EV + """, tg AS (SELECT case_id, min(ts) AS target_ts FROM ev WHERE is_anomaly GROUP BY 1)
  SELECT case_id, event_id, ts, target_ts FROM ev JOIN tg USING (case_id) WHERE abs(epoch_us(ts)-epoch_us(target_ts)) <= 7200000000""")
def _(spark, d):
    ev = canonical_events(spark, d)
    targets = ev.filter("is_anomaly").groupBy("case_id").agg(F.min("ts").alias("target_ts"))
    return jn.around_target(ev, targets, 120).select("case_id", "event_id", "ts", "target_ts")


@query("snk_graph", G + """, x AS (SELECT * FROM edges WHERE rel_type<>'USES_PORT') SELECT src, dst, rel_type, e.ts, event_id, coalesce(e.is_anomaly,false) OR coalesce(s.is_anomaly,false) OR coalesce(t.is_anomaly,false) AS is_anomaly
  FROM x e JOIN (SELECT * FROM nodes WHERE label<>'Service') s ON s.node_id=src JOIN (SELECT * FROM nodes WHERE label<>'Service') t ON t.node_id=dst""")
def _(spark, d):
    from caselens.session import scratch_path
    n, e = built(spark, d)
    path = scratch_path(spark, "graph-json")
    gr.write_graph(n.filter("label <> 'Service'"), e.filter("rel_type <> 'USES_PORT'"), path)
    back = spark.read.schema(e.schema).json(f"{path}/edges")
    return back.select("src", "dst", "rel_type", "ts", "event_id", "is_anomaly")
