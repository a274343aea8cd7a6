"""The driver's tables as canonical events, evidence, cases and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.mitre import tag_text
from caselens.schema import conform
from caselens.session import spread

PROCESSES = [
    "powershell.exe", "cmd.exe", "explorer.exe", "svchost.exe", "rundll32.exe",
    "winword.exe", "certutil.exe", "chrome.exe", "mshta.exe", "python.exe",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _process_of(uid: Column) -> Column:
    names = F.array(*[F.lit(p) for p in PROCESSES])
    return F.get(names, (uid % 10).cast("int"))


def _s(col: Column) -> Column:
    return col.cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_canonical(spread(table(spark, sf_dir, "events")))


def to_canonical(src: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    c, i = F.col("user_id") % 8, F.floor(F.col("user_id") / 8)
    base = src.select(
        F.col("event_id").alias("eid"), "ts", F.col("user_id").alias("uid"),
        F.col("event_type").alias("kind"), "value", k.alias("k"), c.alias("c"),
        F.when(i > 0, F.floor((i - 1) / 3) * 8 + c).alias("pu"),
    )
    kind, kk, uid, cc, eid = (F.col(x) for x in ("kind", "k", "uid", "c", "eid"))
    is_view, is_buy, is_click, is_error = (kind == x for x in ("view", "purchase", "click", "error"))
    types = {"click": "process_creation", "view": "browser_history",
             "purchase": "network_connection", "signup": "auth_event"}
    event_type = F.lit("generic")
    for raw, name in types.items():
        event_type = F.when(kind == raw, name).otherwise(event_type)
    severity = (
        F.when(is_error, F.when(F.col("value") >= 100, "critical").otherwise("high"))
        .when(F.col("value") >= 100, "medium").when(F.col("value") >= 50, "low").otherwise("info")
    )
    sources = F.array(*[F.lit(x) for x in ("pcap", "browser", "csv", "json", "text")])
    proc = _process_of(uid)
    cmd = F.concat(proc, F.when(kk % 7 == 0, " -enc AAA=").otherwise(" run"))
    evidence = F.concat(F.lit("ev_"), _s(cc), F.lit("_"), _s(eid % 5))
    user = F.concat(F.lit("user_"), _s(uid))
    ip = F.when(kk % 4 == 0, F.concat(F.lit("10.0.0."), _s(kk))).otherwise(F.concat(F.lit("185.220.101."), _s(kk)))
    ports = F.array(*[F.lit(p) for p in (443, 4444, 8080, 53)])
    url = F.concat(
        F.lit("http://www.site"), _s(kk % 20), F.lit(".example.com/p/"), _s(kk),
        F.when(kk % 10 == 0, ".exe").otherwise(""),
    )
    df = base.select(
        _s(eid).alias("event_id"), F.concat(F.lit("case_"), _s(cc)).alias("case_id"),
        evidence.alias("evidence_id"), F.concat(F.lit("org_"), _s(cc % 2)).alias("organization_id"),
        "ts", event_type.alias("event_type"),
        F.get(sources, (eid % 5).cast("int")).alias("source"), severity.alias("severity"),
        user.alias("subject"), kind.alias("action"), F.concat(F.lit("res_"), _s(kk)).alias("object"),
        F.concat(F.lit("host_"), _s(cc)).alias("hostname"),
        F.when(~is_view, user).alias("username"), F.when(uid % 3 == 0, "CORP").alias("user_domain"),
        proc.alias("process_name"), uid.alias("pid"), F.col("pu").alias("parent_pid"),
        _process_of(F.col("pu")).alias("parent_process_name"), cmd.alias("command_line"),
        F.when(is_buy, F.concat(F.lit("10.0."), _s(cc), F.lit("."), _s(uid % 250))).alias("source_ip"),
        F.when(is_buy, ip).alias("destination_ip"),
        F.when(is_buy, F.get(ports, kk % 4)).alias("destination_port"),
        F.when(is_buy & (kk % 3 == 0), F.concat(F.lit("cdn"), _s(kk % 10), F.lit(".example.net"))).alias("domain"),
        F.when(is_view, url).alias("url"),
        F.when(is_error & (kk % 6 == 0), F.concat(F.lit("HKLM\\CurrentVersion\\Run\\app"), _s(kk))).alias("registry_key"),
        F.when(is_click & (kk % 9 == 0), F.concat(F.lit("C:\\Temp\\f"), _s(kk), F.lit(".tmp"))).alias("file_path"),
        F.when(is_click & (kk % 11 == 0), F.concat(F.lit("svc"), _s(kk))).alias("service_name"),
        F.to_json(F.struct(
            kk.alias("k"), F.concat(evidence, F.lit(".log")).alias("filename"), proc.alias("process_name"),
            cmd.alias("command_line"), user.alias("user"),
            F.when(is_buy, F.when(kk % 3 == 0, 6).when(kk % 3 == 1, 17).otherwise(1)).alias("proto_code"),
            F.when(is_buy, kk * 10).alias("length"), F.when(is_buy, F.get(ports, kk % 4)).alias("dport"),
            F.when(is_view & (kk % 5 != 0), F.concat(F.lit("Page "), _s(kk))).alias("title"),
        )).alias("details"),
        F.when(is_click, tag_text(cmd)).otherwise(F.array().cast("array<string>")).alias("mitre_techniques"),
        (F.col("value") >= 150).alias("is_anomaly"),
        F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6).alias("anomaly_score"),
        F.when(eid % 7 != 0, F.col("ts")).alias("processed_at"),
        F.concat(evidence, F.lit(".log")).alias("source_file"),
    )
    return conform(df)


# The same rule as SQL, for the side-by-side check.
_PROC_SQL = "CASE CAST({0} % 10 AS INT) " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROCESSES)) + " END"

EV_SQL = f"""
ev0 AS (SELECT event_id AS eid, ts, user_id AS uid, event_type AS kind, value,
  CAST(json_extract_string(props,'$.k') AS INT) AS k, user_id % 8 AS c,
  CASE WHEN floor(user_id/8.0) > 0
       THEN CAST(floor((floor(user_id/8.0)-1)/3.0)*8 + user_id % 8 AS BIGINT) END AS pu FROM events),
ev1 AS (SELECT *, {_PROC_SQL.format('uid')} AS proc, 'user_'||uid AS usr,
  'ev_'||c||'_'||(eid % 5) AS evid FROM ev0),
ev AS (SELECT CAST(eid AS VARCHAR) AS event_id, 'case_'||c AS case_id, evid AS evidence_id,
  'org_'||(c % 2) AS organization_id, ts,
  CASE kind WHEN 'click' THEN 'process_creation' WHEN 'view' THEN 'browser_history'
    WHEN 'purchase' THEN 'network_connection' WHEN 'signup' THEN 'auth_event' ELSE 'generic' END AS event_type,
  CASE eid % 5 WHEN 0 THEN 'pcap' WHEN 1 THEN 'browser' WHEN 2 THEN 'csv' WHEN 3 THEN 'json' ELSE 'text' END AS source,
  CASE WHEN kind='error' THEN CASE WHEN value>=100 THEN 'critical' ELSE 'high' END
    WHEN value>=100 THEN 'medium' WHEN value>=50 THEN 'low' ELSE 'info' END AS severity,
  usr AS subject, kind AS action, 'res_'||k AS object, 'host_'||c AS hostname,
  CASE WHEN kind<>'view' THEN usr END AS username, CASE WHEN uid%3=0 THEN 'CORP' END AS user_domain,
  proc AS process_name, uid AS pid, pu AS parent_pid, {_PROC_SQL.format('pu')} AS parent_process_name,
  proc || CASE WHEN k%7=0 THEN ' -enc AAA=' ELSE ' run' END AS command_line,
  CASE WHEN kind='purchase' THEN '10.0.'||c||'.'||(uid%250) END AS source_ip,
  CASE WHEN kind='purchase' THEN CASE WHEN k%4=0 THEN '10.0.0.'||k ELSE '185.220.101.'||k END END AS destination_ip,
  CASE WHEN kind='purchase' THEN CASE k%4 WHEN 0 THEN 443 WHEN 1 THEN 4444 WHEN 2 THEN 8080 ELSE 53 END END AS destination_port,
  CASE WHEN kind='purchase' AND k%3=0 THEN 'cdn'||(k%10)||'.example.net' END AS domain,
  CASE WHEN kind='view' THEN 'http://www.site'||(k%20)||'.example.com/p/'||k||CASE WHEN k%10=0 THEN '.exe' ELSE '' END END AS url,
  CASE WHEN kind='error' AND k%6=0 THEN 'HKLM'||chr(92)||'CurrentVersion'||chr(92)||'Run'||chr(92)||'app'||k END AS registry_key,
  CASE WHEN kind='click' AND k%9=0 THEN 'C:'||chr(92)||'Temp'||chr(92)||'f'||k||'.tmp' END AS file_path,
  CASE WHEN kind='click' AND k%11=0 THEN 'svc'||k END AS service_name,
  CASE WHEN kind='click' THEN array_to_string(list_filter([
     CASE WHEN proc='powershell.exe' OR k%7=0 THEN 'T1059.001' END,
     CASE WHEN proc='cmd.exe' THEN 'T1059.003' END,
     CASE WHEN proc='certutil.exe' THEN 'T1027' END,
     CASE WHEN proc='mshta.exe' THEN 'T1059' END,
     CASE WHEN proc='rundll32.exe' THEN 'T1027' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS techniques,
  value >= 150 AS is_anomaly, round(least(value/200, 1.0), 6) AS anomaly_score,
  CASE WHEN eid % 7 <> 0 THEN ts END AS processed_at, evid||'.log' AS source_file, k,
  CASE WHEN kind='purchase' THEN CASE k%3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END END AS d_proto,
  CASE WHEN kind='purchase' THEN k*10 END AS d_length, CASE WHEN kind='view' AND k%5<>0 THEN 'Page '||k END AS d_title FROM ev1)"""


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uploaded file per order: the case is the customer."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    exts = F.array(*[F.lit(x) for x in ("csv", "json", "pcap", "sqlite", "log")])
    status = F.array(*[F.lit(x) for x in ("parsed", "failed", "parsing", "queued", "correlating")])
    st = F.get(status, (key % 5).cast("int"))
    start = F.when(key % 3 != 0, F.col("o_orderdate"))
    return o.select(
        F.concat(F.lit("ev_"), _s(key)).alias("evidence_id"),
        F.concat(F.lit("case_"), _s(F.col("o_custkey"))).alias("case_id"),
        F.concat(F.lit("org_"), _s(F.col("o_custkey") % 4)).alias("organization_id"),
        F.concat(F.lit("file_"), _s(key), F.lit("."), F.get(exts, (key % 5).cast("int"))).alias("filename"),
        F.get(exts, (key % 5).cast("int")).alias("file_type"),
        F.floor(F.col("o_totalprice") * F.when(key % 3 == 0, 0.001).otherwise(10.0)).cast("bigint").alias("size_bytes"),
        F.sha2(_s(key % 9000), 256).alias("sha256"),
        st.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(key % 4 != 0, F.col("o_orderdate") + F.make_dt_interval(secs=(key % 3000).cast("double"))).alias("updated_at"),
        F.when(key % 7 == 0, key % 90000).alias("scan_duration_ms"),
        start.alias("processing_started_at"),
        F.when(st.isin("parsed", "failed") & (key % 2 == 0),
               F.col("o_orderdate") + F.make_dt_interval(secs=(key % 500).cast("double"))).alias("processing_finished_at"),
    )


EVIDENCE_SQL = """
evid_rows AS (SELECT 'ev_'||o_orderkey AS evidence_id, 'case_'||o_custkey AS case_id,
  'org_'||(o_custkey%4) AS organization_id,
  'file_'||o_orderkey||'.'||(['csv','json','pcap','sqlite','log'])[o_orderkey%5+1] AS filename,
  (['csv','json','pcap','sqlite','log'])[o_orderkey%5+1] AS file_type,
  CAST(floor(o_totalprice * CASE WHEN o_orderkey%3=0 THEN CAST(0.001 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END) AS BIGINT) AS size_bytes,
  sha256(CAST(o_orderkey%9000 AS VARCHAR)) AS sha256,
  (['parsed','failed','parsing','queued','correlating'])[o_orderkey%5+1] AS status,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey%4<>0 THEN o_orderdate + to_seconds(o_orderkey%3000) END AS updated_at,
  CASE WHEN o_orderkey%7=0 THEN o_orderkey%90000 END AS scan_duration_ms,
  CASE WHEN o_orderkey%3<>0 THEN o_orderdate END AS processing_started_at,
  CASE WHEN o_orderkey%5 IN (0,1) AND o_orderkey%2=0 THEN o_orderdate + to_seconds(o_orderkey%500) END AS processing_finished_at
  FROM orders)"""


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per customer."""
    cu = table(spark, sf_dir, "customer")
    status = F.array(*[F.lit(x) for x in ("open", "in_progress", "suspended", "resolved")])
    return cu.select(
        F.concat(F.lit("case_"), _s(F.col("c_custkey"))).alias("case_id"),
        F.concat(F.lit("org_"), _s(F.col("c_custkey") % 4)).alias("organization_id"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("Segment "), F.lower("c_mktsegment")).alias("description"),
        F.get(status, (F.col("c_nationkey") % 4).cast("int")).alias("status"),
    )


CASES_SQL = """
cases AS (SELECT 'case_'||c_custkey AS case_id, 'org_'||(c_custkey%4) AS organization_id, c_name AS title,
  'Segment '||lower(c_mktsegment) AS description,
  (['open','in_progress','suspended','resolved'])[c_nationkey%4+1] AS status FROM customer)"""


def event_cases(events: DataFrame) -> DataFrame:
    """Cases that the events belong to."""
    return events.groupBy("case_id").agg(F.any_value("organization_id").alias("organization_id")).select(
        "case_id", "organization_id", F.concat(F.lit("Title of "), "case_id").alias("title"),
        F.when(F.col("organization_id") == "org_0", "open").otherwise("resolved").alias("status"), F.lit("").alias("description"))


def event_evidence(events: DataFrame) -> DataFrame:
    """Evidence files that the events come from."""
    return events.groupBy("case_id", "evidence_id").agg(
        F.min("ts").alias("created_at"), (F.count("*") * 100).alias("size_bytes"), F.min("source").alias("file_type")
    ).withColumn("filename", F.concat("evidence_id", F.lit(".log"))).withColumn("status", F.lit("parsed"))


EVENT_CASES_SQL = """ecases AS (SELECT case_id, any_value(organization_id) AS organization_id, 'Title of '||case_id AS title,
  CASE WHEN any_value(organization_id)='org_0' THEN 'open' ELSE 'resolved' END AS status FROM ev GROUP BY case_id),
 eevid AS (SELECT case_id, evidence_id, min(ts) AS created_at, count(*)*100 AS size_bytes, min(source) AS file_type, evidence_id||'.log' AS filename, 'parsed' AS status FROM ev GROUP BY 1,2)"""


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row per event: the organization is the case."""
    ev = canonical_events(spark, sf_dir)
    return ev.select(
        F.col("event_id").alias("audit_id"), F.col("subject").alias("actor_id"), F.col("case_id").alias("organization_id"),
        F.concat(F.lit("evidence."), "action").alias("action"), F.lit("evidence").alias("entity_type"), F.col("evidence_id").alias("entity_id"),
        F.concat(F.lit('{"case_id": "'), "case_id", F.lit('", "filename": "'), "source_file", F.lit('"}')).alias("metadata"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))


AUDIT_SQL = """aud AS (SELECT event_id AS audit_id, subject AS actor_id, case_id AS organization_id, 'evidence.'||action AS action, 'evidence' AS entity_type, evidence_id AS entity_id,
  '{"case_id": "'||case_id||'", "filename": "'||source_file||'"}' AS metadata, strftime(ts,'%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM ev),
 audd AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY created_at, audit_id) AS pos,
  sha256('{"action":"'||action||'","actor_id":"'||actor_id||'","created_at":"'||created_at||'","entity_id":"'||entity_id||'","entity_type":"'||entity_type||'","metadata":"'||replace(metadata,'"','\\"')||'","organization_id":"'||organization_id||'"}') AS digest FROM aud)"""
