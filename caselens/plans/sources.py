"""Normalisers and sinks over evidence derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import mitre as mi
from caselens.functions import text as tx
from caselens.functions import when as wh
from caselens.functions.network import domain_of
from caselens.operators import describe as de
from caselens.operators import graph as gr
from caselens.operators.joins import visits_with_urls
from caselens.plans.graph import G
from caselens.plans.registry import query
from caselens.plans.timeline import EV
from caselens.session import materialize, scratch_path, spread
from caselens.sources import formats as fm
from caselens.sources import manifest as mf
from caselens.sources import normalize as no
from caselens.sources import store as st
from caselens.sources.adapt import EVIDENCE_SQL, canonical_events, documents, evidence_rows, table

TS0 = "2024-06-01 00:00:00"


def ts0():
    return F.lit(TS0).cast("timestamp_ntz")


def tag_sql(col: str) -> str:
    cases = ", ".join("CASE WHEN contains(lower({0}), '{1}') THEN '{2}' END".format(col, w.replace("'", "''"), t) for w, t in mi.KEYWORDS)
    return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ',')"


def sorted_tags(col):
    return F.array_join(F.array_sort(col), ",")


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ---- text, regex and tags over the documents -------------------------------

LINES_SQL = r"""lines AS (SELECT doc_id, line_number, line FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l,1) AS line_number FROM
  (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)),
  LATERAL (SELECT regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line) WHERE line<>'' AND NOT starts_with(line,'#')),
 px AS (SELECT *, nullif(regexp_extract(line,'\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'),'') AS ip, nullif(regexp_extract(line,'https?://[^\s"''>]+'),'') AS url,
  coalesce(nullif(regexp_extract(line,'[a-zA-Z]:\\[^:*?"<>|\r\n]+'),''), nullif(regexp_extract(regexp_replace(line,'https?://[^\s"''>]+',' ','g'),'/[a-zA-Z0-9_\-./]+'),'')) AS path,
  nullif(regexp_extract(line,'\b[a-fA-F0-9]{32,64}\b'),'') AS hash, nullif(regexp_extract(line,'(?i)\b(?:user|username|account)\s*[:=]\s*([a-zA-Z0-9_\-.\\]+)\b',1),'') AS usr FROM lines)"""


@query("src_text", "WITH " + LINES_SQL + f""" SELECT 'doc_'||doc_id AS source_file, line_number, TIMESTAMP '{TS0}' AS ts,
  CASE WHEN regexp_matches(lower(line),'error|fail|denied') THEN 'medium' ELSE 'info' END AS severity, substring(line,1,200) AS object, ip AS source_ip, url, path AS file_path,
  CASE WHEN length(hash)=32 THEN hash END AS file_md5, CASE WHEN length(hash)=64 THEN hash END AS file_sha256, hash AS process_hash, usr AS username FROM px""")
def _(spark, d):
    files = documents(spark, d).select(F.concat(F.lit("doc_"), _s("doc_id")).alias("source_file"), F.col("text").alias("content"))
    ev = no.text(no.text_lines(files), F.col("source_file"), ts0())
    return ev.select("source_file", "line_number", "ts", "severity", "object", "source_ip", "url", "file_path", "file_md5", "file_sha256", "process_hash", "username")


@query("fn_regex", r"""SELECT doc_id, nullif(regexp_extract(text,'\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'),'') AS ip, nullif(regexp_extract(text,'https?://[^\s"''>]+'),'') AS url,
  nullif(regexp_extract(text,'\b[a-fA-F0-9]{32,64}\b'),'') AS hash, nullif(regexp_extract(text,'(?i)\b(?:user|username|account)\s*[:=]\s*([a-zA-Z0-9_\-.\\]+)\b',1),'') AS usr FROM documents""")
def _(spark, d):
    t = F.col("text")
    return documents(spark, d).select(
        "doc_id", tx.first_ip(t).alias("ip"), tx.first_url(t).alias("url"), tx.first_hash(t).alias("hash"), tx.first_user(t).alias("usr"))


@query("fn_tag_text", f"SELECT doc_id, {tag_sql('text')} AS tags FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", sorted_tags(mi.tag_text(F.col("text"))).alias("tags"))


@query("fn_tag_eid", "SELECT event_id, CASE CAST(json_extract_string(props,'$.k') AS INT) WHEN 25 THEN 'T1110' WHEN 88 THEN 'T1059' WHEN 97 THEN 'T1543' WHEN 98 THEN 'T1053' WHEN 57 THEN 'T1547.001' WHEN 63 THEN 'T1005' WHEN 60 THEN 'T1070' ELSE '' END AS tags FROM events")
def _(spark, d):
    eid = tx.json_path(F.col("props"), "k").cast("int") + 4600
    return table(spark, d, "events").select("event_id", F.array_join(mi.tag_event_id(eid), ",").alias("tags"))


@query("fn_name", "SELECT c_custkey, CASE WHEN c_custkey%3<>0 THEN 'Customer' END AS person FROM customer")
def _(spark, d):
    k = F.col("c_custkey") % 3
    q = F.when(k == 0, F.lit("I am an analyst")).when(k == 1, F.concat(F.lit("Hello, MY NAME IS "), "c_name")).otherwise(F.concat(F.lit("hi, i'm customer "), "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", tx.person_name(q).alias("person"))


@query("fn_hash_kind", "SELECT doc_id, (['md5','sha1','sha256'])[doc_id%3+1] AS kind FROM documents")
def _(spark, d):
    t, k = F.col("text"), F.col("doc_id") % 3
    h = F.when(k == 0, F.md5(t)).when(k == 1, F.sha1(t)).otherwise(F.sha2(t, 256))
    return documents(spark, d).select("doc_id", tx.hash_kind(h).alias("kind"))


@query("fn_domain", r"SELECT page_id, regexp_replace(lower(regexp_extract(url,'^https?://(?:[^/?#]*@)?([^/?#:]*)',1)),'^www\.','') AS domain, regexp_replace(lower(regexp_extract(url,'^https?://(?:[^/?#]*@)?([^/?#:]*)',1)),'^[w.]+','') AS compat FROM pages")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", domain_of(u).alias("domain"), domain_of(F.regexp_replace(u, "^http://", ""), "charset").alias("compat"))


TECH_SQL = "t(technique_id, name, tactic) AS (VALUES " + ", ".join("('{}','{}','{}')".format(*x) for x in mi.TECHNIQUES) + ")"


@query("prj_techniques", EV.replace("WITH ", "WITH " + TECH_SQL + ", ", 1) + """, x AS (SELECT event_id, unnest(string_split(techniques, ',')) AS technique_id FROM ev WHERE techniques<>''
  UNION ALL SELECT event_id, 'T9999.'||(k%10) FROM ev WHERE registry_key IS NOT NULL)
  SELECT event_id, technique_id, coalesce(name, technique_id) AS name, coalesce(tactic,'Unknown') AS tactic, 'https://attack.mitre.org/techniques/'||replace(technique_id,'.','/') AS url FROM x LEFT JOIN t USING (technique_id)""")
def _(spark, d):
    ev = canonical_events(spark, d)
    k = tx.json_path(F.col("details"), "k").cast("int")
    extra = F.array(F.concat(F.lit("T9999."), (k % 10).cast("string")))
    ev = ev.withColumn("mitre_techniques", F.when(F.col("registry_key").isNotNull(), F.concat("mitre_techniques", extra)).otherwise(F.col("mitre_techniques")))
    return de.explode_techniques(ev).select("event_id", "technique_id", "name", "tactic", "url")


# ---- structured sources ------------------------------------------------------

RAW = """raw AS (SELECT event_id AS eid, ts, user_id AS uid, event_type AS kind, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)"""


def _raw(spark, d):
    ev = spread(table(spark, d, "events"))
    return ev.select(F.col("event_id").alias("eid"), "ts", F.col("user_id").alias("uid"), F.col("event_type").alias("kind"), tx.json_path(F.col("props"), "k").cast("int").alias("k"))


CSV_SQL = """SELECT eid::VARCHAR AS rec, date_trunc('second', ts) AS ts, CASE WHEN k%3=0 THEN 'process_creation' ELSE 'generic' END AS event_type,
  CASE WHEN k%4=0 THEN 'critical' ELSE 'info' END AS severity, CASE WHEN k%5=0 THEN eid::VARCHAR ELSE 'user_'||uid END AS subject, CASE WHEN k%6=0 THEN 'occurred' ELSE kind END AS action,
  strftime(ts,'%Y-%m-%d %H:%M:%S') AS object, '10.0.0.'||k AS source_ip, CASE WHEN k%2=0 THEN 443 END AS destination_port, uid AS pid, 'run '||k AS command_line FROM raw"""


def _csv_raw(spark, d):
    r, k = _raw(spark, d), F.col("k")
    return r.select(
        _s("eid").alias("Record"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.when(k % 3 == 0, " Process_Creation").otherwise("odd").alias("Type"),
        F.when(k % 4 == 0, "CRITICAL").otherwise("loud").alias("level"), F.when(k % 5 != 0, F.concat(F.lit("user_"), _s("uid"))).otherwise("").alias("User"),
        F.when(k % 6 != 0, F.col("kind")).alias("Operation"), F.concat(F.lit("10.0.0."), _s("k")).alias("Client_IP"),
        F.when(k % 2 == 0, "443").otherwise("https").alias("Destination Port"), _s("uid").alias("PID"), F.concat(F.lit("run "), _s("k")).alias("cmdline"))


@query("src_csv", "WITH " + RAW + CSV_SQL)
def _(spark, d):
    """Written as CSV text, with commas, quotes and line breaks in cells, and read again in blocks."""
    path = scratch_path(spark, "csv")
    note = F.concat(F.lit('said "no, '), F.col("PID"), F.lit('"\n\nand "x\r\n'), F.col("Record"), F.lit(',"'))
    _csv_raw(spark, d).withColumn("Note", F.when(F.col("PID").cast("bigint") % 3 == 0, note).otherwise("plain")).write.csv(path, header=True, escape='"', quoteAll=False)
    ev = no.csv(no.read_csv(spark, path), "log.csv", ts0())
    return ev.select(tx.json_path(F.col("details"), "Record").alias("rec"), "ts", "event_type", "severity", "subject", "action", "object", "source_ip", "destination_port", "pid", "command_line")


JSON_SQL = f"""SELECT eid, CASE WHEN k%9=0 THEN TIMESTAMP '{TS0}' ELSE date_trunc('second', ts) END AS ts, 'user_'||uid AS username, CASE WHEN eid%2=0 THEN 'WORK' END AS user_domain,
  CASE WHEN eid%2=0 THEN 'p'||k||'.exe' ELSE 'flat.exe' END AS process_name, uid AS pid, CASE WHEN eid%2=0 THEN '10.1.1.'||k ELSE '10.2.2.'||k END AS destination_ip,
  CASE WHEN k%3=0 THEN 'T1059,T1110' ELSE '' END AS techniques, CASE WHEN k%2=0 THEN 'high' ELSE 'info' END AS severity, 'json' AS source FROM raw WHERE k%13<>0"""


def _json_items(spark, d):
    r, k = _raw(spark, d), F.col("k")
    even = F.col("eid") % 2 == 0
    user = F.concat(F.lit("user_"), _s("uid"))
    body = F.to_json(F.struct(
        F.col("eid").alias("id"), F.when(k % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon").alias("timestamp"),
        F.when(k % 2 == 0, "HIGH").otherwise("?").alias("level"), F.when(~even, user).alias("username"), F.when(~even, F.lit("flat.exe")).alias("process_name"),
        F.when(~even, F.col("uid")).alias("pid"), F.concat(F.lit("10.2.2."), _s("k")).alias("dst_ip"),
        F.when(even, F.struct(user.alias("username"), F.lit("WORK").alias("domain"))).alias("user"),
        F.when(even, F.struct(F.col("uid").alias("pid"), F.concat(F.lit("p"), _s("k"), F.lit(".exe")).alias("name"))).alias("process"),
        F.when(even, F.struct(F.concat(F.lit("10.1.1."), _s("k")).alias("destination_ip"))).alias("network"),
        F.when(k % 3 == 0, F.array(F.lit("T1059"), F.lit("T1110"))).alias("techniques")))
    return r.select(F.when(k % 13 == 0, F.concat(F.lit("{broken "), body)).otherwise(body).alias("item"))


@query("src_json", "WITH " + RAW + JSON_SQL)
def _(spark, d):
    ev = no.json(_json_items(spark, d), "log.json", ts0())
    return ev.select(tx.json_path(F.col("details"), "id").cast("bigint").alias("eid"), "ts", "username", "user_domain", "process_name", "pid", "destination_ip",
                     F.array_join("mitre_techniques", ",").alias("techniques"), "severity", "source")


HASH_SQL = f"""SELECT 'f'||doc_id||'.bin' AS subject, (['md5:','sha1:','sha256:'])[doc_id%4+1]||h AS object, CASE WHEN doc_id%4=0 THEN h END AS file_md5, CASE WHEN doc_id%4=1 THEN h END AS file_sha1,
  CASE WHEN doc_id%4=2 THEN h END AS file_sha256, TIMESTAMP '{TS0}' AS ts FROM (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN sha256(text) END AS h FROM documents) WHERE h IS NOT NULL"""


@query("src_hash", HASH_SQL)
def _(spark, d):
    t, k = F.col("text"), F.col("doc_id") % 4
    name = F.concat(F.lit("  f"), _s("doc_id"), F.lit(".bin "))
    line = (F.when(k == 0, F.concat(F.upper(F.md5(t)), name)).when(k == 1, F.concat(F.lit("  "), F.sha1(t), F.lit(" *f"), _s("doc_id"), F.lit(".bin")))
            .when(k == 2, F.concat(F.sha2(t, 256), name)).otherwise(F.concat(F.lit("# "), F.md5(t))))
    return no.hashes(documents(spark, d).select(line.alias("line")), None, ts0()).select("subject", "object", "file_md5", "file_sha1", "file_sha256", "ts")


URLS_SQL = """urls AS (SELECT page_id AS id, url||CASE page_id%5 WHEN 0 THEN '/setup.exe' WHEN 1 THEN '.onion/session' ELSE '' END AS url, regexp_extract(html,'<title>([^<]*)</title>',1) AS title,
  page_id%7 AS visit_count FROM pages), visits AS (SELECT event_id AS vid, event_id%400 AS page, ts FROM events)"""
VISIT_COLS = f"""CASE WHEN contains(lower(url),'onion') THEN 'high' WHEN regexp_matches(lower(url),'[.](exe|zip|msi|ps1)') THEN 'medium' ELSE 'info' END AS severity, url AS object, title,
  CASE WHEN regexp_matches(lower(url),'onion|[.](exe|zip|msi|ps1)') THEN {tag_sql('url')} ELSE '' END AS tags, ts"""


def _urls(spark, d):
    k = F.col("page_id") % 5
    return table(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.concat("url", F.when(k == 0, "/setup.exe").when(k == 1, ".onion/session").otherwise("")).alias("url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.col("page_id") % 7).alias("visit_count"))


def _visit_out(ev):
    return ev.select("subject", "severity", "object", tx.json_path(F.col("details"), "title").alias("title"), sorted_tags(F.col("mitre_techniques")).alias("tags"), "ts")


@query("src_chrome", "WITH " + URLS_SQL + f" SELECT 'ChromeProcess' AS subject, {VISIT_COLS} FROM visits JOIN urls ON id=page")
def _(spark, d):
    v = table(spark, d, "events").select((F.col("event_id") % 400).alias("url"), (wh.micros(F.col("ts")) + wh.MICROS_1601_TO_1970).alias("visit_time"))
    return _visit_out(no.chrome(v, _urls(spark, d), ts0()))


@query("jn_visits", "WITH " + URLS_SQL + " SELECT vid, url, visit_count FROM visits JOIN urls ON id=page")
def _(spark, d):
    v = table(spark, d, "events").select(F.col("event_id").alias("vid"), (F.col("event_id") % 400).alias("page"))
    return visits_with_urls(v, _urls(spark, d), "page").select("vid", "url", "visit_count")


@query("src_chrome_urls", "WITH " + URLS_SQL + f" SELECT 'ChromeProcess' AS subject, {VISIT_COLS} FROM (SELECT *, make_timestamp(1700000000000000 + id*1000000) AS ts FROM urls)")
def _(spark, d):
    u = _urls(spark, d).withColumn("last_visit_time", F.lit(1700000000000000 + wh.MICROS_1601_TO_1970) + F.col("id") * 1000000)
    return _visit_out(no.chrome_urls(u, ts0()))


@query("src_firefox", "WITH " + URLS_SQL + f" SELECT 'FirefoxProcess' AS subject, {VISIT_COLS} FROM visits JOIN urls ON id=page WHERE vid%3<>0")
def _(spark, d):
    us = F.when(F.col("event_id") % 3 != 0, wh.micros(F.col("ts")))
    v = table(spark, d, "events").select((F.col("event_id") % 400).alias("place_id"), us.alias("visit_date"))
    return _visit_out(no.firefox(v, _urls(spark, d), ts0()))


@query("src_firefox_places", "WITH " + URLS_SQL + f" SELECT 'FirefoxProcess' AS subject, {VISIT_COLS} FROM (SELECT *, make_timestamp(1700000000000000 + id*1000000) AS ts FROM urls WHERE id%4<>0)")
def _(spark, d):
    u = _urls(spark, d).withColumn("last_visit_date", F.when(F.col("id") % 4 != 0, F.lit(1700000000000000) + F.col("id") * 1000000))
    return _visit_out(no.firefox_places(u, ts0()))


PACKET_SQL = """SELECT l_shipdate AS ts, src AS subject, 'sent_'||lower(pn)||'_packet' AS action, CASE WHEN dport<>0 THEN dst||':'||dport ELSE dst END AS object,
  CASE WHEN dport IN (4444,8080) THEN 'medium' ELSE 'info' END AS severity, CASE WHEN dport IN (4444,8080) THEN 'T1043' ELSE '' END AS tags, pn AS protocol,
  CASE WHEN l_linenumber=3 THEN coalesce(host,dst) WHEN l_linenumber=2 THEN 'q'||l_suppkey||'.example.org' END AS domain, CASE WHEN l_linenumber=3 THEN 'http://'||coalesce(host,dst)||'/x' END AS url,
  CASE WHEN src LIKE '10.%' THEN 'outbound' ELSE 'inbound' END AS direction FROM (SELECT *, CASE WHEN l_returnflag='R' THEN '10.0.' ELSE '8.8.' END||(l_suppkey%200)||'.'||l_linenumber AS src, '93.184.'||(l_partkey%200)||'.1' AS dst,
  (['TCP','UDP','IP'])[l_linenumber%3+1] AS pn, CASE l_partkey%4 WHEN 0 THEN 443 WHEN 1 THEN 4444 WHEN 2 THEN 8080 ELSE 0 END AS dport, CASE WHEN l_partkey%2=0 THEN 'h'||l_partkey END AS host FROM lineitem)"""


@query("src_packets", PACKET_SQL)
def _(spark, d):
    li, pk, ln = table(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")
    p = li.select(
        F.col("l_shipdate").alias("ts"),
        F.concat(F.when(F.col("l_returnflag") == "R", "10.0.").otherwise("8.8."), _s(F.col("l_suppkey") % 200), F.lit("."), _s(ln)).alias("src_ip"),
        F.concat(F.lit("93.184."), _s(pk % 200), F.lit(".1")).alias("dst_ip"), F.when(ln % 3 == 0, 6).when(ln % 3 == 1, 17).otherwise(1).alias("proto"),
        F.lit(64).alias("ttl"), F.col("l_quantity").cast("bigint").alias("length"), F.lit(40000).cast("bigint").alias("sport"),
        F.when(pk % 4 == 0, 443).when(pk % 4 == 1, 4444).when(pk % 4 == 2, 8080).otherwise(0).cast("bigint").alias("dport"), F.lit("S").alias("flags"),
        F.when(ln == 2, F.concat(F.lit("q"), _s("l_suppkey"), F.lit(".example.org."))).alias("dns_query"),
        F.when((ln == 3) & (pk % 2 == 0), F.concat(F.lit("h"), _s(pk))).alias("http_host"), F.when(ln == 3, "/x").alias("http_path"))
    ev = no.packets(p)
    return ev.select("ts", "subject", "action", "object", "severity", sorted_tags(F.col("mitre_techniques")).alias("tags"), "protocol", "domain", "url", "direction")


@query("src_dispatch", "WITH " + LINES_SQL + """ SELECT source_file, source, event_type, subject, action, count(*) AS n FROM (
  SELECT 'doc_'||doc_id||'.log' AS source_file, 'text' AS source, 'generic' AS event_type, 'doc_'||doc_id||'.log' AS subject, 'log_entry' AS action FROM lines WHERE doc_id%4=0
  UNION ALL SELECT 'doc_'||doc_id||'.md5', 'text', 'hash_record', 'a.bin', 'hash_recorded' FROM documents WHERE doc_id%4=1
  UNION ALL SELECT 'doc_'||doc_id||'.json', 'json', 'auth_event', 'u'||doc_id, 'login' FROM documents WHERE doc_id%4=2
  UNION ALL SELECT 'doc_'||doc_id||'.json', 'json', 'generic', 'System', 'occurred' FROM documents WHERE doc_id%4=2
  UNION ALL SELECT 'doc_'||doc_id||'.csv', 'csv', 'registry_change', 'x,'||doc_id, 'occurred' FROM documents WHERE doc_id%4=3
  UNION ALL SELECT 'doc_'||doc_id||'.csv', 'csv', 'generic', 'second', 'occurred' FROM documents WHERE doc_id%4=3) GROUP BY ALL""")
def _(spark, d):
    k, i = F.col("doc_id") % 4, _s("doc_id")
    ext = F.when(k == 0, ".log").when(k == 1, ".md5").when(k == 2, ".json").otherwise(".csv")
    kind = F.when(k <= 1, "text").when(k == 2, "json").otherwise("csv")
    body = (
        F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.md5("text"), F.lit("  a.bin\nnot a hash\n")))
        .when(k == 2, F.concat(F.lit('[{"event_type": "auth_event", "actor": "u'), i, F.lit('", "action": "login"}, {"n": [1, {"a": 2}]}]')))
        .otherwise(F.concat(F.lit('Category,Actor,"Note"\nregistry_change,"x,'), i, F.lit('",hello\nodd,second,\n'))))
    files = documents(spark, d).select(F.concat(F.lit("doc_"), i, ext).alias("source_file"), kind.alias("file_type"), body.alias("content"))
    return no.dispatch(files, ts0()).groupBy("source_file", "source", "event_type", "subject", "action").agg(F.count("*").alias("n"))


# ---- line formats ------------------------------------------------------------------

class Pairs(fm.LineFormat):
    """Records of two lines each; the last one of a file may be cut short."""

    columns = "subject string, action string, object string"

    def __init__(self):
        self.first = None

    def feed(self, line, number):
        if self.first is None:
            self.first = line
        else:
            yield {"subject": self.first[:40], "action": "pair", "object": line[:40]}
            self.first = None

    def close(self):
        if self.first is not None:
            yield {"subject": self.first[:40], "action": "open", "object": "-"}


@query("ext_line_format", r"""WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l,1) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)),
  p AS (SELECT doc_id, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS second, max(n) OVER (PARTITION BY doc_id) AS last FROM l)
  SELECT 'doc_'||doc_id||'.pairs' AS source_file, least(n+1, last) AS line_number, substr(line,1,40) AS subject, CASE WHEN second IS NULL THEN 'open' ELSE 'pair' END AS action, coalesce(substr(second,1,40),'-') AS object FROM p WHERE n%2=1""")
def _(spark, d):
    """A format of two-line records: through ``dispatch`` for one half of the files, laterally in SQL for the other."""
    fm.register_format(spark, "pairs", Pairs)
    files = documents(spark, d).select(F.concat(F.lit("doc_"), _s("doc_id"), F.lit(".pairs")).alias("source_file"), F.lit("pairs").alias("file_type"), F.col("text").alias("content"), (F.col("doc_id") % 2 == 0).alias("_even"))
    columns = ["source_file", "line_number", "subject", "action", "object"]
    through = no.dispatch(files.filter("_even").drop("_even"), ts0()).select(*columns)
    no.unregister("pairs")  # other queries of this session do not meet it
    lines = no.text_lines(files.filter(~F.col("_even")).select("source_file", "content"))
    lateral = spark.sql(f"SELECT {', '.join(columns)} FROM pairs(TABLE({{lines}}))", lines=lines)
    return through.unionByName(lateral)


@query("src_windows_events", "WITH " + RAW + r"""SELECT eid::VARCHAR AS rec, ts, CASE WHEN k%3=0 THEN 'auth_event' WHEN k%3=1 THEN 'process_creation' ELSE 'generic' END AS event_type,
  CASE k%4 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'info' END AS severity, CASE WHEN k%5=0 THEN 'S-1-5-'||uid ELSE 'user <'||uid||'>' END AS subject,
  'event_'||(['4625','4688','7045'])[k%3+1] AS action, CASE WHEN k%3=1 THEN 'C:\x & y\p'||k||'.exe' ELSE 'Security' END AS object, 'host'||(k%7) AS hostname FROM raw""")
def _(spark, d):
    """Events written as XML, on one line or over many, with other lines between them, and read again."""
    r, k = _raw(spark, d), F.col("k")
    code = F.get(F.array(F.lit("4625"), F.lit("4688"), F.lit("7045")), (k % 3).cast("int"))
    gap = F.when(k % 2 == 0, "\n  ").otherwise("")
    user = F.when(k % 5 != 0, F.concat(F.lit('<Data Name="TargetUserName">user &lt;'), _s("uid"), F.lit("&gt;</Data>"))).otherwise('<Data Name="TargetUserName">-</Data>')
    image = F.when(k % 3 == 1, F.concat(F.lit('<Data Name="NewProcessName">C:\\x &amp; y\\p'), _s("k"), F.lit(".exe</Data>"))).otherwise("<Data Name='NewProcessName'/>")
    text = F.concat(
        F.lit('<Event xmlns="e"><System><Provider Name="P"/><EventID Qualifiers="1">'), code, F.lit("</EventID>"), gap, F.lit("<Level>"), _s(k % 4), F.lit("</Level><TimeCreated SystemTime='"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z'/>"), gap, F.lit("<Channel>Security</Channel><Computer>host"), _s(k % 7), F.lit('</Computer><Security UserID="S-1-5-'), _s("uid"),
        F.lit('"/></System>'), gap, F.lit("<EventData>"), user, image, F.lit('<Data Name="rec">'), _s("eid"), F.lit("</Data></EventData>"), gap, F.lit("</Event>"), F.when(k % 4 == 0, "\nnoise <Eventual>\n").otherwise(""))
    texts = r.select(F.concat(F.lit("f"), _s(F.col("eid") % 40), F.lit(".xml")).alias("source_file"), "eid", text.alias("x"))
    # dealt by file before they are gathered: no map task holds lists of its rows, and a task of few files is not merged with others
    files = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_file").groupBy("source_file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("eid", "x"))), lambda p: p["x"]), "").alias("content")).withColumn("file_type", F.lit("windows_events"))
    fm.register_windows_events(spark)
    ev = no.dispatch(files, ts0())
    no.unregister("windows_events")
    return ev.select(tx.json_path(F.get_json_object("details", "$.data"), "rec").alias("rec"), "ts", "event_type", "severity", "subject", "action", "object", "hostname")


# ---- manifest ------------------------------------------------------------------

FILES_SQL = """files AS (SELECT 'org_'||(doc_id%2) AS organization_id, 'case_'||(doc_id%8) AS case_id, 'doc_'||doc_id||(['.pcap','.sqlite3','.csv','.LOG','.sha256','','.zip'])[doc_id%7+1] AS filename,
  CASE doc_id%9 WHEN 0 THEN unhex('D4C3B2A1') WHEN 1 THEN unhex('53514C69746520666F726D6174203300') ELSE ''::BLOB END || encode(text) AS content, doc_id FROM documents),
 man AS (SELECT organization_id, case_id, filename, octet_length(content) AS size_bytes, sha256(content) AS sha256, (['pcap','sqlite3','csv','log','sha256','','zip'])[doc_id%7+1] AS extension,
  CASE doc_id%9 WHEN 0 THEN 'pcap' WHEN 1 THEN 'browser_sqlite' ELSE (['pcap','browser_sqlite','csv','text','text','json','json'])[doc_id%7+1] END AS file_type FROM files)"""


def _files(spark, d):
    i = F.col("doc_id")
    exts = F.array(*[F.lit(x) for x in (".pcap", ".sqlite3", ".csv", ".LOG", ".sha256", "", ".zip")])
    head = F.when(i % 9 == 0, F.unhex(F.lit("D4C3B2A1"))).when(i % 9 == 1, F.unhex(F.lit("53514C69746520666F726D6174203300"))).otherwise(F.unhex(F.lit("")))
    return documents(spark, d).select(
        F.concat(F.lit("org_"), _s(i % 2)).alias("organization_id"), F.concat(F.lit("case_"), _s(i % 8)).alias("case_id"),
        F.concat(F.lit("doc_"), _s(i), F.get(exts, (i % 7).cast("int"))).alias("filename"), F.concat(head, F.encode("text", "UTF-8")).alias("content"))


@query("src_manifest", "WITH " + FILES_SQL + " SELECT *, organization_id||'/'||case_id||'/'||sha256||'.'||extension AS object_name FROM man")
def _(spark, d):
    return mf.manifest(_files(spark, d))


@query("src_detect", "WITH " + FILES_SQL + " SELECT filename, file_type FROM man")
def _(spark, d):
    return _files(spark, d).select("filename", mf.file_type(F.col("content"), F.col("filename")).alias("file_type"))


@query("src_empty_guard", "WITH " + EVIDENCE_SQL + """, hit AS (SELECT DISTINCT 'ev_'||l_orderkey AS evidence_id FROM lineitem WHERE l_returnflag='R'),
  emp AS (SELECT * FROM evid_rows WHERE evidence_id NOT IN (SELECT evidence_id FROM hit))
  SELECT 'failed' AS kind, file_type AS source, count(*) AS n FROM emp WHERE file_type IN ('pcap','sqlite','csv') GROUP BY 2 UNION ALL SELECT 'marker', file_type, count(*) FROM emp WHERE file_type NOT IN ('pcap','sqlite','csv') GROUP BY 2
  UNION ALL SELECT 'event', file_type, count(*) FROM evid_rows JOIN (SELECT 'ev_'||l_orderkey AS evidence_id FROM lineitem WHERE l_returnflag='R') USING (evidence_id) GROUP BY 2""")
def _(spark, d):
    files = evidence_rows(spark, d)
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("ev_"), _s("l_orderkey")).alias("evidence_id"))
    ev = lines.join(files.select("evidence_id", "case_id", F.col("file_type").alias("source")), "evidence_id").withColumn("action", F.lit("seen"))
    out, failed = mf.guard_empty(ev, files, ts0())
    kind = F.when(F.col("action") == "evidence_ingested", "marker").otherwise("event")
    return out.groupBy(kind.alias("kind"), "source").agg(F.count("*").alias("n")).unionByName(
        failed.groupBy(F.lit("failed").alias("kind"), F.col("file_type").alias("source")).agg(F.count("*").alias("n")))


# ---- sinks -----------------------------------------------------------------------

@query("snk_events", EV + "SELECT case_id, evidence_id, count(*) AS n, min(ts) AS first_ts FROM ev GROUP BY 1,2")
def _(spark, d):
    path = scratch_path(spark, "events")
    st.append_events(canonical_events(spark, d), path)
    return st.read_events(spark, path).groupBy("case_id", "evidence_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("snk_replace", EV + "SELECT case_id, evidence_id, count(*) AS n, sum((severity='critical')::INT)::BIGINT AS critical FROM ev GROUP BY 1,2")
def _(spark, d):
    path, ev = scratch_path(spark, "events"), canonical_events(spark, d)
    st.append_events(ev, path)
    again = ev.filter(F.col("source").isin("pcap", "csv"))
    st.replace_events(again, path)
    st.replace_events(again, path)
    return st.read_events(spark, path).groupBy("case_id", "evidence_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))


@query("snk_cascade", G + """, doom AS (SELECT DISTINCT case_id, evidence_id FROM ev WHERE evidence_id='ev_1_1' OR case_id='case_4'),
  n1 AS (SELECT * FROM nodes WHERE NOT (label IN ('Event','BrowserVisit','Evidence') AND evidence_id IN (SELECT evidence_id FROM doom))),
  e1 AS (SELECT * FROM edges WHERE src IN (SELECT node_id FROM n1) AND dst IN (SELECT node_id FROM n1) AND (evidence_id IS NULL OR evidence_id NOT IN (SELECT evidence_id FROM doom))),
  n2 AS (SELECT * FROM n1 WHERE case_id<>'case_4' AND (case_id<>'case_1' OR node_id IN (SELECT src FROM e1) OR node_id IN (SELECT dst FROM e1)))
  SELECT 'events' AS t, case_id, count(*) AS n FROM ev WHERE evidence_id NOT IN (SELECT evidence_id FROM doom) GROUP BY 2 UNION ALL SELECT 'nodes', case_id, count(*) FROM n2 GROUP BY 2
  UNION ALL SELECT 'edges', case_id, count(*) FROM e1 WHERE case_id<>'case_4' GROUP BY 2""")
def _(spark, d):
    ev = canonical_events(spark, d)
    evidence = ev.select("case_id", "evidence_id").distinct()
    doomed = evidence.filter("evidence_id = 'ev_1_1' or case_id = 'case_4'")
    nodes, edges = materialize(gr.nodes_of(ev), "nodes"), materialize(gr.edges_of(ev), "edges")
    out = st.cascade({"events": ev, "nodes": nodes, "edges": edges}, materialize(doomed, "doomed"), evidence)
    res = None
    for t in ("events", "nodes", "edges"):
        one = out[t].groupBy(F.lit(t).alias("t"), "case_id").agg(F.count("*").alias("n"))
        res = one if res is None else res.unionByName(one)
    return res
