"""Filters, paging, aggregates and windows over the canonical events."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import text as tx
from caselens.functions import when as wh
from caselens.functions.network import is_private_ip, is_risky_port, url_severity
from caselens.operators import aggregates as ag
from caselens.operators import describe as de
from caselens.operators import filters as fl
from caselens.operators import joins as jn
from caselens.operators import ordered as od
from caselens.plans.registry import query
from caselens.sources.adapt import (
    CASES_SQL, EV_SQL, EVIDENCE_SQL, canonical_events, case_rows, documents, evidence_rows, table,
)
from caselens.streaming.alerts import admin_after_hours, brute_force, log_cleared, long_dns

EV = "WITH " + EV_SQL + "\n"
EVID = "WITH " + EVIDENCE_SQL + "\n"
CASES = "WITH " + CASES_SQL + "\n"
ORDER = ["ts", "event_id"]

# ---- filters -------------------------------------------------------------

KEYS = "event_id, case_id, evidence_id, severity, event_type"
K = ["event_id", "case_id", "evidence_id", "severity", "event_type"]


@query("flt_scope", EV + f"SELECT {KEYS}, ts FROM ev WHERE case_id='case_3' AND evidence_id='ev_3_2'")
def _(spark, d):
    return fl.scope(canonical_events(spark, d), "case_3", "ev_3_2").select(*K, "ts")


@query("flt_basic", EV + f"""SELECT {KEYS}, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id
  ORDER BY ts, event_id) AS rank FROM ev WHERE severity='high' AND event_type='generic') WHERE rank <= 100""")
def _(spark, d):
    df = fl.basic(canonical_events(spark, d), "high", "generic")
    return od.top_n(df, ["case_id"], ORDER, 100).select(*K, "rank")


@query("flt_severity_ci", EV + f"SELECT {KEYS} FROM ev WHERE lower(severity)='critical'")
def _(spark, d):
    return fl.by_severity(canonical_events(spark, d), " Critical ").select(*K)


@query("flt_type_ci", EV + f"SELECT {KEYS} FROM ev WHERE lower(event_type)='auth_event'")
def _(spark, d):
    return fl.by_type(canonical_events(spark, d), "AUTH_Event").select(*K)


@query("flt_anomaly", EV + f"""SELECT {KEYS}, 'yes' AS side FROM ev WHERE is_anomaly OR anomaly_score > 0.5
  UNION ALL SELECT {KEYS}, 'no' FROM ev WHERE is_anomaly IS NOT TRUE""")
def _(spark, d):
    ev = canonical_events(spark, d)
    yes = fl.by_anomaly(ev, True).select(*K, F.lit("yes").alias("side"))
    return yes.unionByName(fl.by_anomaly(ev, False).select(*K, F.lit("no").alias("side")))


@query("flt_search", EV + f"""SELECT {KEYS} FROM ev WHERE contains(lower(subject),'t1059.003')
  OR contains(lower(action),'t1059.003') OR contains(lower(object),'t1059.003') OR contains(techniques,'T1059.003')
  UNION ALL SELECT {KEYS} FROM ev WHERE contains(lower(concat_ws('|', subject, action, object, source, event_type,
    lower(techniques), source_file, process_name, command_line)), 'certutil.exe -e')
  UNION ALL SELECT {KEYS} FROM ev WHERE contains(lower(concat_ws('|', subject, action, object, source, event_type,
    lower(techniques), source_file, process_name, command_line)), 'ev_5_1.')""")
def _(spark, d):
    ev = canonical_events(spark, d)
    out = [fl.search(ev, t).select(*K) for t in ("t1059.003", "CertUtil.exe -E", "ev_5_1.")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("flt_triple", EV + f"SELECT {KEYS} FROM ev WHERE subject<>'' AND object<>''")
def _(spark, d):
    return fl.with_triple(canonical_events(spark, d)).select(*K)


@query("flt_private_ip", EV + """SELECT event_id, destination_ip, source_ip, destination_ip LIKE '10.%' AS dst_private,
  true AS src_private FROM ev WHERE destination_ip IS NOT NULL""")
def _(spark, d):
    ev = canonical_events(spark, d).filter(F.col("destination_ip").isNotNull())
    return ev.select(
        "event_id", "destination_ip", "source_ip", is_private_ip(F.col("destination_ip")).alias("dst_private"),
        is_private_ip(F.concat("source_ip", F.lit(":443"))).alias("src_private"),
    )


@query("flt_risky_port", EV + f"SELECT {KEYS}, destination_port FROM ev WHERE destination_port IN (4444,1337,6667,8080)")
def _(spark, d):
    ev = canonical_events(spark, d)
    return ev.filter(is_risky_port(F.col("destination_port"))).select(*K, "destination_port")


@query("flt_url_risk", """SELECT page_id, CASE WHEN contains(lower(url),'onion') OR contains(lower(url),'torproject') THEN 'high'
  WHEN regexp_matches(lower(url), '\\.(exe|zip|msi|ps1)') THEN 'medium' ELSE 'info' END AS severity FROM pages
  UNION ALL SELECT event_id + 1000000000, CASE WHEN event_type='view' AND CAST(json_extract_string(props,'$.k') AS INT)%10=0
  THEN 'medium' ELSE 'info' END FROM events WHERE event_type='view'""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", url_severity(F.col("url")).alias("severity"))
    ev = canonical_events(spark, d).filter(F.col("url").isNotNull())
    return pages.unionByName(ev.select(
        (F.col("event_id").cast("bigint") + 1000000000).alias("page_id"), url_severity(F.col("url")).alias("severity")
    ))


@query("flt_active", EVID + "SELECT evidence_id, case_id, status FROM evid_rows WHERE status IN ('uploaded','queued','parsing','processing','analyzing','building_graph','correlating')")
def _(spark, d):
    return fl.active(evidence_rows(spark, d)).select("evidence_id", "case_id", "status")


@query("flt_cases", CASES + """SELECT case_id, title, status FROM cases WHERE organization_id='org_1' AND status='open'
  AND (contains(lower(title),'building') OR contains(lower(description),'building'))""")
def _(spark, d):
    return fl.cases(case_rows(spark, d), "org_1", "open", "Building").select("case_id", "title", "status")


# ---- sort, page, top-k ---------------------------------------------------

@query("srt_page", EV + """SELECT case_id, event_id, rank, total, CAST(ceil(total/50.0) AS BIGINT) AS total_pages FROM (
  SELECT case_id, event_id, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) AS rank,
  count(*) OVER (PARTITION BY case_id) AS total FROM ev) WHERE rank > 50 AND rank <= 100""")
def _(spark, d):
    p = od.page(canonical_events(spark, d), ["case_id"], True, 2, 50)
    return p.select("case_id", "event_id", "rank", "total", "total_pages")


@query("srt_top_anom", EV + """SELECT case_id, event_id, anomaly_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id
  ORDER BY anomaly_score DESC, event_id) AS rank FROM ev WHERE is_anomaly) WHERE rank <= 30""")
def _(spark, d):
    from caselens.operators.context import top_anomalies
    return top_anomalies(canonical_events(spark, d), 30).select("case_id", "event_id", "anomaly_score", "rank")


@query("srt_newest", EVID + """SELECT case_id, evidence_id, created_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id
  ORDER BY created_at DESC, evidence_id) AS rank FROM evid_rows) WHERE rank <= 100""")
def _(spark, d):
    df = od.top_n(evidence_rows(spark, d), ["case_id"], [F.desc("created_at"), F.asc("evidence_id")], 100)
    return df.select("case_id", "evidence_id", "created_at", "rank")


# ---- aggregates ----------------------------------------------------------

@query("agg_stats", EV + """SELECT case_id, evidence_id, count(*) AS total, count(processed_at) AS total_processed,
  count(*) FILTER (is_anomaly OR anomaly_score>0.5) AS anomalies,
  count(*) FILTER (severity IN ('critical','high')) AS critical FROM ev
  GROUP BY GROUPING SETS ((case_id), (case_id, evidence_id))""")
def _(spark, d):
    return ag.stats(canonical_events(spark, d))


@query("agg_freq", EV + "".join(f"""{'UNION ALL ' if i else ''}SELECT case_id, '{c}' AS field, {c} AS value, count(*) AS n,
  round(count(*)*1.0/any_value(t.total),6) AS freq FROM ev JOIN (SELECT case_id, count(*) AS total FROM ev GROUP BY 1) t
  USING (case_id) GROUP BY case_id, {c} """ for i, c in enumerate(["subject", "object", "action"])))
def _(spark, d):
    ev = canonical_events(spark, d)
    out = None
    for c in ("subject", "object", "action"):
        one = ag.frequency(ev, c, ["case_id"]).select(
            "case_id", F.lit(c).alias("field"), F.col(c).alias("value"), "n", F.round("freq", 6).alias("freq"))
        out = one if out is None else out.unionByName(one)
    return out


@query("agg_sev_counts", EV + "SELECT case_id, lower(severity) AS severity, count(*) AS n FROM ev WHERE is_anomaly GROUP BY 1, 2")
def _(spark, d):
    return ag.severity_counts(canonical_events(spark, d))


@query("agg_span", EV + """SELECT case_id, min(ts) AS first_ts, max(ts) AS last_ts,
  round((epoch_us(max(ts))-epoch_us(min(ts)))/1e6/3600, 2) AS span_hours FROM ev GROUP BY 1""")
def _(spark, d):
    return od.span(canonical_events(spark, d), ["case_id"])


@query("agg_tech_set", EV + """SELECT DISTINCT case_id, unnest(string_split(techniques, ',')) AS technique_id FROM ev
  WHERE is_anomaly AND techniques<>''""")
def _(spark, d):
    return ag.technique_set(canonical_events(spark, d).filter("is_anomaly"))


@query("agg_case_status", CASES + """SELECT organization_id, count(*) AS total, count(*) FILTER (status='open') AS open,
  count(*) FILTER (status='in_progress') AS in_progress, count(*) FILTER (status='suspended') AS suspended,
  count(*) FILTER (status='resolved') AS resolved FROM cases GROUP BY 1""")
def _(spark, d):
    return ag.case_status(case_rows(spark, d), ["organization_id"])


@query("agg_largest", EVID + """SELECT case_id, filename, size_bytes, files, total_bytes FROM (SELECT *,
  row_number() OVER (PARTITION BY case_id ORDER BY size_bytes DESC, evidence_id DESC) AS rn,
  count(*) OVER (PARTITION BY case_id) AS files, CAST(sum(size_bytes) OVER (PARTITION BY case_id) AS BIGINT) AS total_bytes
  FROM evid_rows) WHERE rn=1""")
def _(spark, d):
    return ag.largest_file(evidence_rows(spark, d))


@query("agg_parsed", EVID + "SELECT case_id, count(*) AS files, count(*) FILTER (status='parsed') AS parsed FROM evid_rows GROUP BY 1")
def _(spark, d):
    return ag.parsed_count(evidence_rows(spark, d))


# ---- windows -------------------------------------------------------------

SESSION_SQL = """
SELECT case_id, s + 1 AS session_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS event_count FROM (
  SELECT case_id, ts, CAST(sum(CASE WHEN gap > INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ts, eo
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (SELECT case_id, ts, event_id AS eo, ts - lag(ts) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS gap FROM ev))
GROUP BY case_id, s"""


@query("win_session", EV + SESSION_SQL)
def _(spark, d):
    return od.sessions(canonical_events(spark, d), ["case_id"])


MILESTONES_SQL = """mc AS (SELECT case_id, count(*) AS n_all,
    count(*) FILTER (is_anomaly OR severity IN ('critical','high')) AS n_key FROM ev GROUP BY 1),
  mo AS (SELECT ev.*, n_all, n_key, (is_anomaly OR severity IN ('critical','high')) AS k2,
    row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS pos FROM ev JOIN mc USING (case_id)),
  mf AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS frn FROM mo WHERE NOT k2 AND n_key<12
    AND (pos-1) % greatest(1, n_all // (12-n_key)) = 0),
  mu AS (SELECT case_id, event_id, ts FROM mo WHERE k2 UNION ALL SELECT case_id, event_id, ts FROM mf WHERE frn <= 12-n_key),
  ms AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS rank FROM mu)"""


@query("win_milestones", EV + "," + MILESTONES_SQL + " SELECT case_id, event_id, ts, rank FROM ms WHERE rank <= 12")
def _(spark, d):
    return od.milestones(canonical_events(spark, d)).select("case_id", "event_id", "ts", "rank")


@query("win_latest_report", """SELECT l_suppkey AS case_id, l_orderkey AS report_id, l_linenumber AS version, l_shipdate AS created_at FROM (SELECT *,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn=1""")
def _(spark, d):
    reports = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("report_id"),
        F.col("l_linenumber").alias("version"), F.col("l_shipdate").alias("created_at"), "l_partkey",
    )
    newest = F.max(F.struct("created_at", "report_id", "version", "l_partkey")).alias("m")
    return reports.groupBy("case_id").agg(newest).select("case_id", "m.report_id", "m.version", "m.created_at")


# ---- projections ---------------------------------------------------------

@query("prj_scope", EVID + """SELECT evidence_id, case_id, organization_id, count(*) AS n FROM evid_rows
  JOIN (SELECT 'ev_'||l_orderkey AS evidence_id FROM lineitem) USING (evidence_id) GROUP BY ALL""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("f_"), F.col("l_orderkey").cast("string")).alias("source_file"))
    man = evidence_rows(spark, d).withColumn("source_file", F.replace("evidence_id", F.lit("ev_"), F.lit("f_")))
    return de.stamp_scope(rows, man).groupBy("evidence_id", "case_id", "organization_id").agg(F.count("*").alias("n"))


@query("prj_defaults", EV + """SELECT event_id, coalesce(s1, event_type) AS source, coalesce(s2, coalesce(s1, event_type)) AS subject,
  coalesce(s3, event_type) AS action, coalesce(s4, 'event') AS object FROM (SELECT *,
  CASE WHEN k%2=0 THEN source END s1, CASE WHEN k%3=0 THEN subject END s2, CASE WHEN k%5=0 THEN action END s3,
  CASE WHEN k%7=0 THEN object END s4 FROM ev)""")
def _(spark, d):
    ev = canonical_events(spark, d)
    k = tx.json_path(F.col("details"), "k").cast("int")
    for c, m, miss in (("source", 2, None), ("subject", 3, ""), ("action", 5, None), ("object", 7, "")):
        ev = ev.withColumn(c, F.when(k % m == 0, F.col(c)).otherwise(F.lit(miss)))
    return de.fill_defaults(ev).select("event_id", "source", "subject", "action", "object")


@query("prj_describe", EV + """SELECT event_id, CASE
  WHEN source='pcap' OR event_type='network_connection' THEN 'Host '||subject||' transmitted a '||
    CASE d_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'IP' END||' packet'||
    CASE WHEN d_length<>0 THEN ' ('||d_length||' bytes)' ELSE '' END||' to destination '||object||
    CASE WHEN destination_port IS NOT NULL THEN ' on port '||destination_port ELSE '' END||'.'
  WHEN event_type='browser_history' THEN 'User visited '||coalesce(''''||d_title||'''', 'link')||' via '||subject||'.'
  WHEN event_type='process_creation' THEN 'Process '||subject||' executed child process '||object||' running command '''||command_line||'''.'
  WHEN event_type='auth_event' THEN 'User '||subject||' performed '||action||' on target '||object||'.'
  ELSE subject||' '||action||' '||object||'.' END AS description FROM ev""")
def _(spark, d):
    return de.with_description(canonical_events(spark, d)).select("event_id", "description")


SENT_SQL = """sent AS (SELECT event_id, case_id, CASE WHEN source='browser' THEN 'Browser '''||action||''' domain '''||
  CASE WHEN url IS NULL THEN object ELSE 'site'||(k%20)||'.example.com' END||'''. Threat Severity: '||severity||'.'
  ELSE 'At '||CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S') ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S.%f') END||', '||subject||' performed '''||action||
  ''' on '''||object||'''. Threat Severity: '||severity||'.' END AS sentence FROM ev)"""


@query("prj_sentence", EV + "," + SENT_SQL + " SELECT event_id, sentence FROM sent")
def _(spark, d):
    return canonical_events(spark, d).select("event_id", de.sentence().alias("sentence"))


@query("set_sentences", EV + "," + SENT_SQL + """, m AS (SELECT *, md5(sentence) AS sentence_id FROM sent)
  SELECT case_id, event_id, sentence_id, copies FROM m JOIN (SELECT case_id, sentence_id, count(*) AS copies FROM m GROUP BY 1,2) USING (case_id, sentence_id)""")
def _(spark, d):
    from caselens.operators.vectors import sentence_map, unique_sentences
    m = sentence_map(canonical_events(spark, d))
    u = unique_sentences(m)
    return m.join(u, ["case_id", "sentence_id"]).select("case_id", "event_id", "sentence_id", "copies")


@query("prj_int_guard", """SELECT event_id, CASE WHEN event_id%3=0 THEN user_id END AS pid FROM events""")
def _(spark, d):
    ev = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("-"), F.col("user_id").cast("string"))).otherwise("0x1f")
    return ev.select("event_id", tx.int_guard(raw).alias("pid"))


@query("prj_truncate", """SELECT doc_id, substring(text,1,150) AS subject, substring(text,1,250) AS object,
  substring(text,1,80) AS label, md5(substring(text,1,2000)) AS turn_md5 FROM documents""")
def _(spark, d):
    t = F.col("text")
    return documents(spark, d).select(
        "doc_id", de.truncate(t, 150).alias("subject"), de.truncate(t, 250).alias("object"),
        de.truncate(t, 80).alias("label"), F.md5(de.truncate(t, 2000)).alias("turn_md5"))


SCAN_SQL = """scan AS (SELECT *, (epoch_us(updated_at)-epoch_us(created_at))/1e6 AS age,
  CAST(floor((epoch_us(processing_finished_at)-epoch_us(processing_started_at))/1e6*1000) AS BIGINT) AS measured FROM evid_rows)"""


@query("prj_scan_time", EVID + "," + SCAN_SQL + """ SELECT evidence_id, CASE WHEN status IN ('parsed','failed') THEN
  coalesce(scan_duration_ms, CASE WHEN measured>=0 THEN measured END,
  CASE WHEN age>0 AND age<1800 THEN greatest(1000, CAST(floor(age*1000) AS BIGINT)) ELSE 2000 END) END AS scan_ms FROM scan""")
def _(spark, d):
    return evidence_rows(spark, d).select("evidence_id", de.scan_ms().alias("scan_ms"))


@query("prj_sizes", EVID + """SELECT evidence_id, CASE WHEN size_bytes<1024 THEN size_bytes||' Bytes'
  WHEN size_bytes<1048576 THEN printf('%.1f KB', size_bytes/1024.0) ELSE printf('%.2f MB', size_bytes/1048576.0) END AS size_text,
  CASE WHEN s<60 THEN s||'s' WHEN s<3600 THEN (s//60)||'m '||(s%60)||'s' ELSE (s//3600)||'h '||((s//60)%60)||'m '||(s%60)||'s' END AS duration
  FROM (SELECT *, size_bytes % 9000 AS s FROM evid_rows)""")
def _(spark, d):
    return evidence_rows(spark, d).select(
        "evidence_id", tx.size_text(F.col("size_bytes")).alias("size_text"),
        tx.duration_text(F.col("size_bytes") % 9000).alias("duration"))


# ---- joins ---------------------------------------------------------------

@query("jn_dedupe", EVID + """SELECT DISTINCT n.evidence_id, n.case_id FROM evid_rows n WHERE status<>'parsed'
  AND NOT EXISTS (SELECT 1 FROM evid_rows o WHERE o.status='parsed' AND o.case_id=n.case_id AND o.sha256=n.sha256)""")
def _(spark, d):
    ev = evidence_rows(spark, d)
    return jn.new_files(ev.filter("status <> 'parsed'"), ev.filter("status = 'parsed'")).select("evidence_id", "case_id")


@query("jn_counts", EVID + """SELECT evidence_id, case_id, coalesce(n,0) AS event_count FROM evid_rows LEFT JOIN
  (SELECT 'ev_'||l_orderkey AS evidence_id, count(*) AS n FROM lineitem GROUP BY 1) USING (evidence_id)""")
def _(spark, d):
    evid = evidence_rows(spark, d)
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("ev_"), F.col("l_orderkey").cast("string")).alias("evidence_id"))
    rows = lines.join(evid.select("evidence_id", "case_id"), "evidence_id")
    return jn.with_event_counts(evid, rows).select("evidence_id", "case_id", "event_count")


@query("jn_exists", "WITH " + EVIDENCE_SQL + "," + CASES_SQL + """ SELECT evidence_id, case_id FROM evid_rows e WHERE EXISTS (
  SELECT 1 FROM cases c WHERE c.case_id=e.case_id AND c.organization_id='org_2')""")
def _(spark, d):
    return jn.in_organization(evidence_rows(spark, d), case_rows(spark, d), "org_2").select("evidence_id", "case_id")


@query("jn_actor", """SELECT o_orderkey AS audit_id, CASE WHEN o_orderkey%10=0 THEN CASE WHEN o_orderkey%20=0 THEN 'System' ELSE 'Investigator' END
  WHEN o_custkey%3=0 THEN 'c'||o_custkey||'@example.org' ELSE c_name END AS actor_name,
  CASE WHEN o_orderkey%10=0 THEN '' ELSE 'c'||o_custkey||'@example.org' END AS actor_email FROM orders JOIN customer ON c_custkey=o_custkey""")
def _(spark, d):
    key = F.col("o_orderkey")
    audit = table(spark, d, "orders").select(
        key.alias("audit_id"),
        F.when(key % 20 == 0, F.lit("")).when(key % 10 == 0, F.lit("u_gone"))
        .otherwise(F.concat(F.lit("u_"), F.col("o_custkey").cast("string"))).alias("actor_id"))
    cust = F.col("c_custkey").cast("string")
    users = table(spark, d, "customer").select(
        F.concat(F.lit("u_"), cust).alias("user_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"),
        F.concat(F.lit("c"), cust, F.lit("@example.org")).alias("email"))
    return jn.with_actor(audit, users).select("audit_id", "actor_name", "actor_email")


@query("jn_scores", EV + """SELECT event_id, CASE WHEN k%2=0 THEN value2>0.9 ELSE is_anomaly END AS is_anomaly,
  CASE WHEN k%2=0 THEN value2 ELSE anomaly_score END AS anomaly_score FROM (SELECT *, round(k/100.0,6) AS value2 FROM ev)""")
def _(spark, d):
    ev = canonical_events(spark, d)
    k = tx.json_path(F.col("details"), "k").cast("int")
    scores = ev.filter(k % 2 == 0).select("event_id", (F.round(k / 100, 6) > 0.9).alias("flag"), F.round(k / 100, 6).alias("score"))
    return jn.with_scores(ev, scores).select("event_id", "is_anomaly", "anomaly_score")


# ---- scalar functions over the tables -------------------------------------

@query("fn_ts", """SELECT event_id, CASE event_id%6 WHEN 5 THEN TIMESTAMP '2020-01-01 00:00:00' WHEN 3 THEN date_trunc('day', ts)
  ELSE date_trunc('second', ts) END AS parsed FROM events""")
def _(spark, d):
    e, ts = F.col("event_id") % 6, F.col("ts")
    fmts = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss"]
    raw = F.lit("yesterday at noon")
    for i, f in enumerate(fmts):
        raw = F.when(e == i, F.date_format(ts, f)).otherwise(raw)
    default = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", wh.parse_ts(raw, default).alias("parsed"))


@query("fn_epochs", "SELECT event_id, ts AS chrome_ts, ts AS firefox_ts FROM events")
def _(spark, d):
    us = wh.micros(F.col("ts"))
    return table(spark, d, "events").select(
        "event_id", wh.from_chrome_micros(us + wh.MICROS_1601_TO_1970).alias("chrome_ts"),
        wh.from_firefox_micros(us).alias("firefox_ts"))


@query("fn_time_feats", """SELECT event_id, CAST(hour(t) AS DOUBLE) AS hour, CASE WHEN isodow(t)>=6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weekend
  FROM (SELECT event_id, ts AS t FROM events WHERE event_id%9<>0) UNION ALL SELECT event_id, 12.0, 0.0 FROM events WHERE event_id%9=0""")
def _(spark, d):
    t = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return table(spark, d, "events").select("event_id", wh.hour_or_noon(t).alias("hour"), wh.is_weekend(t).alias("weekend"))


@query("fn_humanize", EV + """SELECT event_id, array_to_string(list_transform(string_split(replace(event_type,'_',' '),' '),
  lambda w: upper(w[1])||w[2:]),' ') AS label FROM ev""")
def _(spark, d):
    return canonical_events(spark, d).select("event_id", tx.humanize(F.col("event_type")).alias("label"))


@query("fn_enum_guard", EV + """SELECT event_id, severity, CASE WHEN k%4=0 THEN 'generic' ELSE event_type END AS event_type FROM ev""")
def _(spark, d):
    from caselens.schema import EVENT_TYPES, SEVERITIES
    k = tx.json_path(F.col("details"), "k").cast("int")
    sev = F.concat(F.lit(" "), F.upper("severity"), F.lit(" "))
    kind = F.when(k % 4 == 0, "no_such_type").otherwise(F.upper("event_type"))
    return canonical_events(spark, d).select(
        "event_id", tx.enum_guard(sev, SEVERITIES, "info").alias("severity"),
        tx.enum_guard(kind, EVENT_TYPES, "generic").alias("event_type"))


@query("fn_finding_id", "SELECT c_custkey, 'lolbin_'||substring(md5(c_name||c_mktsegment),1,10) AS finding_id FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.finding_id("lolbin", F.col("c_name"), F.col("c_mktsegment")).alias("finding_id"))


@query("fn_point_id", "SELECT c_custkey, CAST(('0x'||substring(md5(c_name),1,8)) AS BIGINT) AS point_id FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.point_id(F.col("c_name")).alias("point_id"))


@query("fn_sha_json", """SELECT o_orderkey, sha256('{"key":"'||o_orderkey||'","priority":"'||o_orderpriority||'","status":"'||o_orderstatus||'"}') AS h FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        tx.sha_json(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), key=F.col("o_orderkey")).alias("h"))


@query("fn_json_path", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", tx.json_path(F.col("props"), "k").cast("bigint").alias("k"))


@query("fn_direction", EV + """SELECT event_id, CASE WHEN destination_ip LIKE '10.%' THEN 'outbound' ELSE 'inbound' END AS direction FROM ev
  WHERE destination_ip IS NOT NULL""")
def _(spark, d):
    from caselens.functions.network import direction
    ev = canonical_events(spark, d).filter(F.col("destination_ip").isNotNull())
    return ev.select("event_id", direction(F.col("destination_ip")).alias("direction"))


# ---- alerts --------------------------------------------------------------

@query("alert_bruteforce", EV + """, f AS (SELECT destination_ip AS ip, ts, event_id FROM ev WHERE event_type='network_connection')
  SELECT * FROM (SELECT ip, event_id, ts, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS failures FROM f)
  WHERE failures >= 3""")
def _(spark, d):
    ev = canonical_events(spark, d).filter("event_type = 'network_connection'")
    ev = ev.select(F.col("destination_ip").alias("ip"), "ts", "event_id")
    return brute_force(ev, threshold=3, seconds=86400)


@query("alert_logclear", EV + "SELECT event_id, case_id FROM ev WHERE k=2")
def _(spark, d):
    ev = canonical_events(spark, d).withColumn("win_event_id", tx.json_path(F.col("details"), "k").cast("int") + 1100)
    return log_cleared(ev).select("event_id", "case_id")


@query("alert_admin_hours", EV + "SELECT event_id, case_id FROM ev WHERE k=72 AND (hour(ts) < 8 OR hour(ts) >= 18)")
def _(spark, d):
    ev = canonical_events(spark, d).withColumn("win_event_id", tx.json_path(F.col("details"), "k").cast("int") + 4600)
    return admin_after_hours(ev).select("event_id", "case_id")


@query("alert_dns_len", """SELECT page_id FROM pages WHERE length(url) > 45""")
def _(spark, d):
    return long_dns(table(spark, d, "pages").withColumnRenamed("url", "dns_query")).select("page_id")
