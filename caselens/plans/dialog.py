"""Audit chain, questions, turns and per-case context."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import mitre as mi
from caselens.functions.when import micros
from caselens.operators import aggregates as ag
from caselens.operators import audit as au
from caselens.operators import context as cx
from caselens.operators import correlate as co
from caselens.operators import dialog as dg
from caselens.operators import filters as fl
from caselens.operators import ordered as od
from caselens.operators import vectors as ve
from caselens.plans.graph import FIND, G, R, built, findings
from caselens.plans.registry import query
from caselens.plans.sources import TECH_SQL
from caselens.plans.timeline import EV, MILESTONES_SQL, SENT_SQL
from caselens.session import materialize, scratch_path
from caselens.sources.adapt import (
    AUDIT_SQL, EVENT_CASES_SQL, audit_rows, canonical_events, event_cases, event_evidence, table,
)
from caselens.sources.store import write_reports

# ---- audit ---------------------------------------------------------------------

CHAIN_SQL = EV.replace("WITH", "WITH RECURSIVE", 1) + "," + AUDIT_SQL.replace("audd AS (", "audd AS MATERIALIZED (") + f""", seg AS MATERIALIZED (
  SELECT organization_id, (pos-1)//{au.SEGMENT} AS s, sha256(string_agg(digest,'' ORDER BY pos)) AS d FROM audd GROUP BY 1,2),
 seeds AS (SELECT organization_id, s, d, repeat('0',64) AS seed FROM seg WHERE s=0
  UNION ALL SELECT n.organization_id, n.s, n.d, sha256(p.seed||p.d) FROM seeds p JOIN seg n ON n.organization_id=p.organization_id AND n.s=p.s+1),
 ch AS (SELECT a.organization_id, a.audit_id, a.pos, seed AS prev_hash, sha256(seed||digest) AS self_hash FROM audd a JOIN seeds x ON x.organization_id=a.organization_id AND a.pos=x.s*{au.SEGMENT}+1
  UNION ALL SELECT d.organization_id, d.audit_id, d.pos, c.self_hash, sha256(c.self_hash||d.digest) FROM ch c JOIN audd d ON d.organization_id=c.organization_id AND d.pos=c.pos+1 AND c.pos%{au.SEGMENT}<>0)"""


@query("win_audit_append", CHAIN_SQL + " SELECT organization_id, audit_id, prev_hash, self_hash FROM ch")
def _(spark, d):
    """Two halves of the log, the later one chained to the stored earlier one."""
    rows = audit_rows(spark, d)
    early = F.col("created_at") < "2024-01-15"
    first = materialize(au.append(rows.filter(early)), "audit")
    second = au.append(rows.filter(~early), first)
    return first.unionByName(second.select(*first.columns)).select("organization_id", "audit_id", "prev_hash", "self_hash")


@query("win_last_hash", CHAIN_SQL + " SELECT organization_id, arg_max(self_hash, pos) AS last_hash FROM ch GROUP BY 1")
def _(spark, d):
    return od.last_hash(au.append(audit_rows(spark, d)))


@query("win_audit_verify", EV + "," + AUDIT_SQL + """, bad AS (SELECT organization_id, min(pos) AS p FROM audd WHERE action='evidence.error' AND organization_id IN ('case_2','case_5') GROUP BY 1)
  SELECT a.organization_id, any_value(bad.p) IS NULL AS valid, count(*) AS total, any_value(bad.p) AS broken_at, any_value(audit_id) FILTER (a.pos=bad.p) AS broken_id FROM audd a LEFT JOIN bad USING (organization_id) GROUP BY 1""")
def _(spark, d):
    log = materialize(au.append(audit_rows(spark, d)), "audit")
    forged = (F.col("action") == "evidence.error") & F.col("organization_id").isin("case_2", "case_5")
    return au.verify(log.withColumn("actor_id", F.when(forged, "mallory").otherwise(F.col("actor_id"))))


@query("flt_audit", EV + "," + AUDIT_SQL + " SELECT audit_id, action FROM aud WHERE organization_id='case_1' AND contains(lower(metadata),'ev_1_3.log')")
def _(spark, d):
    log = audit_rows(spark, d).withColumn("self_hash", F.lit(""))
    return fl.audit(log, "case_1", "case_1", "EV_1_3.log").select("audit_id", "action")


# ---- turns ---------------------------------------------------------------------

@query("win_last_turns", """SELECT conv_id, turn, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE role IN ('user','assistant')) WHERE rank<=6""")
def _(spark, d):
    return dg.last_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role", "rank")


WEAK = "|".join(p.replace("'", "''") for p in fl.WEAK_PHRASES)
REPLY = "CASE WHEN conv_id%5=0 AND role='assistant' THEN 'After a long look at all of the logs I CANNOT determine who did this thing, sorry.' WHEN conv_id%7=0 AND role='assistant' THEN 'I found it in the log.' ELSE text END"


def _reply():
    a = F.col("role") == "assistant"
    return F.when(a & (F.col("conv_id") % 5 == 0), "After a long look at all of the logs I CANNOT determine who did this thing, sorry.").when(
        a & (F.col("conv_id") % 7 == 0), "I found it in the log.").otherwise(F.col("text"))


@query("flt_weak_reply", rf"SELECT conv_id, turn FROM (SELECT *, regexp_replace({REPLY}, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE role='assistant') WHERE length(t)<50 OR regexp_matches(lower(t), '{WEAK}')")
def _(spark, d):
    t = table(spark, d, "conversations").filter("role = 'assistant'")
    return t.filter(fl.is_weak_reply(_reply())).select("conv_id", "turn")


@query("flt_stale_turns", "SELECT conv_id, turn, role FROM conversations WHERE NOT (role='assistant' AND conv_id%3=0 AND turn%4=3)")
def _(spark, d):
    t = table(spark, d, "conversations")
    note = F.when(F.col("conv_id") % 3 == 0, F.when(F.col("turn") % 4 == 3, " (gone.pcap) (trace.log)").otherwise(" (trace.log)")).otherwise(" (trace.log)")
    turns = t.withColumn("text", F.concat(F.regexp_replace("text", "[.]", ""), note))
    files = t.select("conv_id").distinct().withColumn("filename", F.lit("trace.log"))
    return fl.drop_stale_turns(turns, files).select("conv_id", "turn", "role")


@query("set_diff_files", "SELECT conv_id, turn, CASE WHEN turn%2=0 THEN 'gone.pcap' ELSE '' END AS missing FROM conversations WHERE role='assistant'")
def _(spark, d):
    t = table(spark, d, "conversations").filter("role = 'assistant'")
    text = F.concat(F.lit("(trace.log) "), F.when(F.col("turn") % 2 == 0, "(gone.pcap)").otherwise("(TRACE.log? no)"), F.lit(" (trace.log)"))
    present = F.array(F.lit("trace.log"), F.lit("TRACE.log"))
    return t.select("conv_id", "turn", F.array_join(F.array_except(fl.mentioned_files(text), present), ",").alias("missing"))


# ---- questions -------------------------------------------------------------------

QUESTIONS = [
    "Hello", "My name is alice cooper", "How to upload new evidence?", "How many nodes are in the graph?", "What is the total number of cases?",
    "What's the name of that file?", "Which file is largest?", "Which evidence is important here?", "How many files were uploaded?", "list evidence please",
    "Is this file malicious?", "Show me the attack path", "How many anomalies are there?", "How many critical events?", "how many log entries", "What is the case status?", "",
]
N_Q = len(QUESTIONS)
_QSQL = "CASE (conv_id*7+turn) % 20 " + " ".join("WHEN {} THEN '{}'".format(i, q.replace("'", "''")) for i, q in enumerate(QUESTIONS)) + " ELSE text END"
Q_SQL = f"qs AS (SELECT conv_id||':'||turn AS question_id, 'case_'||(conv_id%8) AS case_id, {_QSQL} AS question, lower(trim(regexp_replace({_QSQL}, '\\s+', ' ', 'g'))) AS q FROM conversations)"


def _q(words):
    return "(" + " OR ".join("contains(q,'{}')".format(w.replace("'", "''")) for w in words) + ")"


INTENT_SQL = ("CASE WHEN q='' THEN 'greeting' WHEN q IN (" + ",".join("'" + w.replace("'", "''") + "'" for w in dg.GREETINGS) + ") OR " +
              " OR ".join(f"starts_with(q,'{w}')" for w in dg.GREETING_STARTS) + f" OR {_q(dg.INTRODUCTIONS)} THEN 'greeting' WHEN {_q(dg.UPLOAD)} THEN 'upload_instructions' WHEN regexp_matches(q,'" +
              "|".join(f"(?:{p})" for p in dg.GRAPH_STATS) + f"') THEN 'graph_stats' WHEN contains(q,'case') AND {_q(dg.CASE_COUNT)} THEN 'cases_count' WHEN {_q(dg.FILE_NAME)} THEN 'file_name'"
              f" WHEN {_q(dg.FILE_SIZE)} THEN 'file_size' WHEN {_q(dg.IMPORTANCE)} THEN 'evidence_importance' WHEN regexp_matches(q,'{dg.COUNTING}') AND {_q(dg.EVIDENCE_WORDS)} THEN 'evidence_count'"
              f" WHEN {_q(dg.EVIDENCE_LIST)} THEN 'evidence_list' WHEN {_q(dg.SECURITY)} THEN 'file_security' WHEN {_q(dg.GRAPH_QUERY)} THEN 'graph_query' WHEN regexp_matches(q,'{dg.COUNTING}') THEN 'structured_count'"
              f" WHEN regexp_matches(q,'{dg.CASE_STATUS}') THEN 'case_status' ELSE 'semantic_rag' END")


def questions(spark, d):
    n = (F.col("conv_id") * 7 + F.col("turn")) % 20
    pick = F.when(n < N_Q, F.get(F.array(*[F.lit(q) for q in QUESTIONS]), n.cast("int"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.concat(F.lit("case_"), (F.col("conv_id") % 8).cast("string")).alias("case_id"), pick.alias("question"))


@query("nl_intent", "WITH " + Q_SQL + f" SELECT question_id, {INTENT_SQL} AS intent FROM qs")
def _(spark, d):
    return questions(spark, d).select("question_id", dg.intent(F.col("question")).alias("intent"))


@query("nl_answers", R.rstrip() + "," + EVENT_CASES_SQL + "," + Q_SQL + f""", qi AS (SELECT *, {INTENT_SQL} AS intent FROM qs),
  st AS (SELECT case_id, count(*) AS total, count(*) FILTER (is_anomaly OR anomaly_score>0.5) AS an, count(*) FILTER (severity IN ('critical','high')) AS cr FROM ev GROUP BY 1),
  fs AS (SELECT case_id, count(*) AS files, arg_max(filename, size_bytes*1000+ascii(substring(filename,-5,1))) AS big, max(size_bytes) AS bs, arg_max(filename, strftime(created_at,'%Y-%m-%dT%H:%M:%S.%f')) AS newest, arg_max(file_type, strftime(created_at,'%Y-%m-%dT%H:%M:%S.%f')) AS nt,
    string_agg(filename, ', ' ORDER BY created_at DESC, evidence_id) AS names FROM eevid GROUP BY 1),
  fo AS (SELECT case_id, string_agg(explanation, '; ' ORDER BY rn) AS found FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, correlation_id) AS rn FROM allf) WHERE rn<=5 GROUP BY 1),
  gc AS (SELECT case_id, n, e FROM (SELECT case_id, count(*) AS n FROM nodes GROUP BY 1) JOIN (SELECT case_id, count(*) AS e FROM edges GROUP BY 1) USING (case_id)),
  oc AS (SELECT organization_id, count(*) AS oc FROM ecases GROUP BY 1)
  SELECT question_id, case_id, intent, CASE intent WHEN 'greeting' THEN CASE WHEN contains(q,'alice') THEN 'Hello Alice' ELSE 'Hello' END||'! What would you like to know about '||title||'?' WHEN 'upload_instructions' THEN 'Open the Evidence tab of the case and add the file there.'
   WHEN 'graph_stats' THEN 'The graph of '||title||' has '||n||' nodes and '||e||' relationships.' WHEN 'cases_count' THEN 'Cases of your organization: '||oc||'.'
   WHEN 'file_name' THEN 'Files of '||title||': '||names||'.' WHEN 'evidence_list' THEN files||' files in '||title||': '||names||'.'
   WHEN 'file_size' THEN 'The largest file of '||title||' is '||big||', '||CASE WHEN bs<1024 THEN bs||' Bytes' WHEN bs<1048576 THEN printf('%.1f KB', bs/1024.0) ELSE printf('%.2f MB', bs/1048576.0) END||'.'
   WHEN 'evidence_importance' THEN 'The newest file of '||title||' is '||newest||' ('||nt||').' WHEN 'evidence_count' THEN 'Files in '||title||': '||files||'.'
   WHEN 'file_security' THEN CASE WHEN an>0 OR cr>0 THEN 'Found in this case: '||an||' anomalies, '||cr||' critical or high events.' ELSE 'Nothing suspicious was found in this case.' END WHEN 'graph_query' THEN coalesce(found, 'No rule has found anything in '||title||'.')
   WHEN 'structured_count' THEN CASE WHEN contains(q,'anomal') THEN an||' events are marked as anomalies.' WHEN contains(q,'critical') OR contains(q,'high') THEN cr||' events are rated critical or high.'
     WHEN contains(q,'event') OR contains(q,'log') THEN format('{{:,}}', total)||' events in all.' END
   WHEN 'case_status' THEN title||' is '||upper(status)||'.' END AS answer
  FROM qi JOIN ecases USING (case_id) JOIN st USING (case_id) JOIN fs USING (case_id) LEFT JOIN fo USING (case_id) JOIN gc USING (case_id) JOIN oc USING (organization_id)""")
def _(spark, d):
    ev = canonical_events(spark, d)
    n, e = (materialize(x, "graph") for x in built(spark, d, "actual"))
    sizes = n.groupBy("case_id").agg(F.count("*").alias("nodes")).join(e.groupBy("case_id").agg(F.count("*").alias("edges")), "case_id")
    stats = ag.stats(ev).filter("evidence_id is null")
    return dg.answers(questions(spark, d), stats, event_evidence(ev), event_cases(ev), co.all_findings(n, e, ev), sizes)


@query("nl_tech_search", "WITH " + TECH_SQL.replace("t(technique_id, name, tactic)", "t0(technique_id, name, tactic)") + """, t AS (SELECT *, row_number() OVER () AS ord FROM t0), qq AS (SELECT p_partkey AS query_id, CASE p_partkey%4 WHEN 0 THEN 'about t1110 and t1059.001 please'
   WHEN 1 THEN 'privilege escalation by '||p_name WHEN 2 THEN 'show '||p_name||' web cookie' ELSE p_name END AS q FROM part),
  m AS (SELECT query_id, technique_id, ord, contains(q,lower(technique_id)) OR contains(q,lower(name)) OR contains(q,lower(tactic)) AS ex, len(list_filter(string_split(lower(name||' '||tactic),' '), lambda w: contains(q,w)))>0 AS wd FROM qq, t),
  b AS (SELECT query_id, bool_or(ex) AS ae, bool_or(wd) AS aw FROM m GROUP BY 1)
  SELECT query_id, rank, technique_id FROM (SELECT query_id, technique_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank FROM m JOIN b USING (query_id) WHERE ex OR (NOT ae AND wd) OR (NOT ae AND NOT aw)) WHERE rank<=3""")
def _(spark, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    text = (F.when(k == 0, F.lit("about T1110 and t1059.001 please")).when(k == 1, F.concat(F.lit("Privilege Escalation by "), name))
            .when(k == 2, F.concat(F.lit("show "), name, F.lit(" WEB cookie"))).otherwise(name))
    return dg.search_techniques(table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text")))


# ---- context ------------------------------------------------------------------------

TOP30 = "top30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY anomaly_score DESC, event_id) AS rank FROM ev WHERE is_anomaly) WHERE rank<=30)"


@query("agg_risk", R.rstrip().replace("WITH ", "WITH " + TECH_SQL + ", ", 1) + "," + TOP30 + """, a AS (SELECT case_id, count(*) FILTER (anomaly_score>0.6 OR severity IN ('critical','high')) AS high_anomalies FROM top30 GROUP BY 1),
  f AS (SELECT case_id, count(*) AS findings FROM allf GROUP BY 1), tt AS (SELECT DISTINCT case_id, unnest(string_split(techniques,',')) AS technique_id FROM top30 WHERE techniques<>''),
  k AS (SELECT case_id, count(*) FILTER (tactic IN ('Execution','Credential Access','Persistence','Lateral Movement')) AS risky_techniques FROM tt LEFT JOIN t USING (technique_id) GROUP BY 1)
  SELECT case_id, high_anomalies, findings, coalesce(risky_techniques,0) AS risky_techniques, CASE WHEN s>=60 THEN 'critical' WHEN s>=30 THEN 'high' WHEN s>=10 THEN 'elevated' ELSE 'low' END AS level, least(s,100) AS score
  FROM (SELECT *, high_anomalies*15+findings*10+coalesce(risky_techniques,0)*20 AS s FROM a JOIN f USING (case_id) LEFT JOIN k USING (case_id))""")
def _(spark, d):
    anom = cx.top_anomalies(canonical_events(spark, d), 30)
    return ag.risk(anom, findings(spark, d), mi.with_technique_names(ag.technique_set(anom)))


CASE_TEXT_SQL = """tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY anomaly_score DESC, event_id) AS rank FROM ev WHERE is_anomaly) WHERE rank<=20),
  te AS (SELECT case_id, string_agg(DISTINCT t, ', ' ORDER BY t) AS tech FROM (SELECT case_id, unnest(string_split(techniques,',')) AS t FROM tp WHERE techniques<>'') GROUP BY 1),
  su AS (SELECT case_id, string_agg(subject, ', ' ORDER BY subject) AS subj FROM (SELECT case_id, subject, row_number() OVER (PARTITION BY case_id ORDER BY subject) AS rn FROM (SELECT DISTINCT case_id, subject FROM tp)) WHERE rn<=10 GROUP BY 1),
  ctx AS (SELECT case_id, title||' ('||status||')'||coalesce('; techniques '||tech,'')||coalesce('; seen '||subj,'') AS case_text FROM ecases LEFT JOIN te USING (case_id) LEFT JOIN su USING (case_id))"""


@query("agg_case_text", EV + "," + EVENT_CASES_SQL + "," + CASE_TEXT_SQL + " SELECT case_id, case_text FROM ctx")
def _(spark, d):
    ev = canonical_events(spark, d)
    return ve.case_text(event_cases(ev), ev).select("case_id", "case_text")


SESSIONS_OF_CASE = """lg AS (SELECT case_id, ts, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY case_id ORDER BY ts)) > 900000000 THEN 1 ELSE 0 END AS new FROM ev WHERE ts IS NOT NULL),
  ss AS (SELECT case_id, s, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM (SELECT case_id, ts, sum(new) OVER (PARTITION BY case_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM lg) GROUP BY 1,2),
  se AS (SELECT case_id, string_agg(epoch_us(lo)||'-'||epoch_us(hi)||':'||n, ',' ORDER BY lo) AS sessions FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY lo) AS rn FROM ss) WHERE rn<=5 GROUP BY 1)"""


@query("ctx_bundle", R.rstrip() + "," + EVENT_CASES_SQL + "," + TOP30 + """, a AS (SELECT case_id, string_agg(event_id, ',' ORDER BY rank) AS anomalies FROM top30 GROUP BY 1),
  f AS (SELECT case_id, string_agg(correlation, ',' ORDER BY rn) AS correlations, count(*) AS findings_total FROM (SELECT case_id, rule||':'||source||'>'||target||':'||score||':'||explanation AS correlation, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, correlation_id) AS rn FROM allf) GROUP BY 1),
  e AS (SELECT case_id, string_agg(evidence_id||'/'||filename, ',' ORDER BY created_at DESC, evidence_id) AS evidence_list, count(*) AS files_total FROM eevid GROUP BY 1),
  k AS (SELECT case_id, string_agg(DISTINCT t, ',' ORDER BY t) AS techniques FROM (SELECT case_id, unnest(string_split(techniques,',')) AS t FROM top30 WHERE techniques<>'') GROUP BY 1),
""" + SESSIONS_OF_CASE + """
  SELECT case_id, title, anomalies, correlations, evidence_list, techniques, sessions, findings_total, files_total FROM ecases LEFT JOIN a USING (case_id) LEFT JOIN f USING (case_id) LEFT JOIN e USING (case_id) LEFT JOIN k USING (case_id) LEFT JOIN se USING (case_id)""")
def _(spark, d):
    ev = canonical_events(spark, d)
    us = lambda c: micros(c.cast("timestamp_ntz")).cast("string")
    listed = {
        "anomalies": lambda x: x.event_id, "correlations": lambda x: F.concat(x.rule, F.lit(":"), x.source, F.lit(">"), x.target, F.lit(":"), x.score.cast("string"), F.lit(":"), x.explanation),
        "evidence_list": lambda x: F.concat_ws("/", x.evidence_id, x.filename), "techniques": lambda x: x,
        "sessions": lambda x: F.concat(us(x.start_ts), F.lit("-"), us(x.end_ts), F.lit(":"), x.event_count.cast("string"))}
    b = cx.bundle(ev, findings(spark, d), event_evidence(ev), event_cases(ev), lines=listed)
    return b.select("case_id", "title", *listed, "findings_total", "files_total")


TECHS_OF_TOP = "tt AS (SELECT DISTINCT case_id, unnest(string_split(techniques,',')) AS technique_id FROM top30 WHERE techniques<>'')"


@query("ctx_prompt", R.rstrip() + "," + EVENT_CASES_SQL + "," + TOP30 + "," + TECHS_OF_TOP + """, fl AS (SELECT case_id, string_agg(rn||'. '||filename||', '||file_type||', '||status||', '||printf('%.1f KB', size_bytes/1024.0), chr(10) ORDER BY rn) AS s FROM
    (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, evidence_id) AS rn FROM eevid) GROUP BY 1),
  an AS (SELECT case_id, string_agg(rank||'. '||strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||' ['||upper(severity)||'] '||concat_ws(' / ',subject,action,object)||CASE WHEN techniques='' THEN '' ELSE ' ('||replace(techniques,',',', ')||')' END, chr(10) ORDER BY rank) AS s FROM top30 WHERE rank<=12 GROUP BY 1),
  te AS (SELECT case_id, string_agg('- '||technique_id, chr(10) ORDER BY technique_id) AS s FROM tt GROUP BY 1),
  fi AS (SELECT case_id, string_agg(rn||'. '||rule||': '||source||' -> '||target||', score '||score, chr(10) ORDER BY rn) AS s FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, correlation_id) AS rn FROM allf) WHERE rn<=10 GROUP BY 1)
  SELECT case_id, concat_ws(chr(10), 'Case '||case_id||': '||title||' ('||status||')', '<EVIDENCE>', '## Files'||chr(10)||fl.s, '## Anomalies'||chr(10)||an.s, '## Findings'||chr(10)||fi.s,
   '## Techniques'||chr(10)||te.s, '</EVIDENCE>') AS prompt FROM ecases LEFT JOIN fl USING (case_id) LEFT JOIN an USING (case_id) LEFT JOIN te USING (case_id) LEFT JOIN fi USING (case_id)""")
def _(spark, d):
    ev = canonical_events(spark, d)
    return cx.prompt(cx.bundle(ev, findings(spark, d), event_evidence(ev), event_cases(ev)))


@query("ctx_playbook", R.rstrip().replace("WITH ", "WITH " + TECH_SQL + ", ", 1) + "," + TOP30 + "," + TECHS_OF_TOP + """,
  mk AS (SELECT case_id, lower(coalesce(target,'')) AS w, false AS known FROM allf UNION ALL SELECT case_id, lower(coalesce(object,'')), false FROM top30 UNION ALL SELECT case_id, '', coalesce(tactic='Credential Access',false) FROM tt LEFT JOIN t USING (technique_id)),
  tg AS (SELECT case_id, bool_or(regexp_matches(w,'powershell|cmd|mimikatz|certutil')) AS tool, bool_or(known OR regexp_matches(w,'lsass|mimikatz')) AS cred FROM mk GROUP BY 1)
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY o) AS step, kind FROM (SELECT case_id, 1 AS o, 'process' AS kind FROM tg WHERE tool UNION ALL SELECT case_id, 2, 'credential' FROM tg WHERE cred UNION ALL SELECT case_id, 3, 'isolation' FROM tg UNION ALL SELECT case_id, 4, 'telemetry' FROM tg)""")
def _(spark, d):
    anom = cx.top_anomalies(canonical_events(spark, d), 30)
    techs = mi.with_technique_names(ag.technique_set(anom))
    return cx.playbook(anom, findings(spark, d), techs).select("case_id", "step", "kind")


@query("ctx_entity_hits", R.rstrip() + "," + TOP30 + """, qq AS (SELECT conv_id||':'||turn AS question_id, 'case_'||(conv_id%8) AS case_id, (['powershell','cmd','certutil','explorer'])[conv_id%4+1] AS word FROM conversations WHERE role='user')
  SELECT question_id, 'anomaly' AS kind, event_id AS id, anomaly_score AS score, rank FROM (SELECT question_id, event_id, anomaly_score, row_number() OVER (PARTITION BY question_id ORDER BY anomaly_score DESC, event_id) AS rank FROM qq JOIN top30 USING (case_id)
  WHERE contains(subject,word) OR contains(object,word) OR contains(process_name,word) OR contains(command_line,word)) WHERE rank<=5
  UNION ALL SELECT question_id, 'finding', correlation_id, CAST(score AS DOUBLE), rank FROM (SELECT question_id, correlation_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, correlation_id) AS rank FROM qq JOIN allf USING (case_id)
  WHERE contains(lower(concat_ws(chr(10),source,target)),word)) WHERE rank<=5""")
def _(spark, d):
    words = F.array(*[F.lit(w) for w in ("PowerShell", "cmd", "certutil", "explorer")])
    q = table(spark, d, "conversations").filter("role = 'user'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.concat(F.lit("case_"), (F.col("conv_id") % 8).cast("string")).alias("case_id"),
        F.concat(F.lit("what did "), F.get(words, (F.col("conv_id") % 4).cast("int")), F.lit(" do?")).alias("question"))
    anom = cx.top_anomalies(canonical_events(spark, d), 30).drop("rank")
    return cx.entity_hits(q, findings(spark, d), anom)


@query("ctx_citations", R.rstrip() + "," + EVENT_CASES_SQL + "," + TOP30 + """ SELECT case_id, 'evidence_file' AS kind, filename AS source, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, filename) AS rank FROM eevid
  UNION ALL SELECT case_id, 'event_log', event_id, rank FROM top30 WHERE rank<=4
  UNION ALL SELECT * FROM (SELECT case_id, 'mitre_technique', t, row_number() OVER (PARTITION BY case_id ORDER BY t) AS rank FROM (SELECT DISTINCT case_id, unnest(string_split(techniques,',')) AS t FROM top30 WHERE techniques<>'')) WHERE rank<=3
  UNION ALL SELECT * FROM (SELECT case_id, 'graph_correlation', correlation_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, correlation_id) AS rank FROM allf) WHERE rank<=2""")
def _(spark, d):
    ev = canonical_events(spark, d)
    anom = cx.top_anomalies(ev, 30).withColumn("score", F.col("anomaly_score")).drop("rank")
    return cx.citations(event_evidence(ev), anom, ag.technique_set(anom), findings(spark, d))


@query("snk_report", R.rstrip() + "," + EVENT_CASES_SQL + "," + TOP30 + "," + MILESTONES_SQL + "," + SESSIONS_OF_CASE + """,
  st AS (SELECT case_id, count(*) AS total, count(*) FILTER (is_anomaly OR anomaly_score>0.5) AS anomalies, count(*) FILTER (severity IN ('critical','high')) AS critical, round((epoch_us(max(ts))-epoch_us(min(ts)))/1e6/3600, 2) AS span_hours FROM ev GROUP BY 1),
  a AS (SELECT case_id, string_agg(event_id||':'||severity, ',' ORDER BY rank) AS top_anomalies FROM top30 WHERE rank<=10 GROUP BY 1),
  f AS (SELECT case_id, string_agg(rule||':'||source||'>'||target||':'||score, ',' ORDER BY rn) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, correlation_id) AS rn FROM allf) WHERE rn<=8 GROUP BY 1),
  m AS (SELECT case_id, string_agg(event_id, ',' ORDER BY rank) AS timeline FROM ms WHERE rank<=12 GROUP BY 1),
  e AS (SELECT case_id, count(*) AS files FROM eevid GROUP BY 1)
  SELECT case_id, title, total, anomalies, critical, span_hours, files, top_anomalies, findings, timeline, sessions FROM ecases LEFT JOIN st USING (case_id) LEFT JOIN a USING (case_id) LEFT JOIN f USING (case_id) LEFT JOIN m USING (case_id) LEFT JOIN e USING (case_id) LEFT JOIN se USING (case_id)""")
def _(spark, d):
    ev, path = canonical_events(spark, d), scratch_path(spark, "reports")
    reports = cx.report(ev, findings(spark, d), event_evidence(ev), event_cases(ev))
    write_reports(reports, path)
    r = spark.read.schema(reports.schema).json(path)
    us = lambda c: micros(c.cast("timestamp_ntz")).cast("string")
    listed = {
        "top_anomalies": lambda x: F.concat_ws(":", x.event_id, x.severity), "timeline": lambda x: x.event_id,
        "findings": lambda x: F.concat(x.rule, F.lit(":"), x.source, F.lit(">"), x.target, F.lit(":"), x.score.cast("string")),
        "sessions": lambda x: F.concat(us(x.start_ts), F.lit("-"), us(x.end_ts), F.lit(":"), x.event_count.cast("string"))}
    return r.select("case_id", "title", "total", "anomalies", "critical", "span_hours", "files", *[F.array_join(F.transform(c, fn), ",").alias(c) for c, fn in listed.items()])


# ---- vectors -------------------------------------------------------------------------

def _embed_sql(texts: str, key: str, text: str) -> str:
    """Vectors of (key, text) rows as text: the parts that are not zero, by place, with six decimals."""
    return f"""wd AS (SELECT {key} AS k, w FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '\\W+')) AS w FROM {texts}) WHERE w<>''),
  tf AS MATERIALIZED (SELECT k, ('0x'||substr(md5(w),1,8))::BIGINT%{ve.DIM} AS b, count(*) AS c FROM wd GROUP BY 1,2), nt AS (SELECT count(*) AS n FROM {texts}),
  idf AS (SELECT b, ln((any_value(n)+1.0::DOUBLE)/(count(*)+1.0::DOUBLE)) AS w FROM tf, nt GROUP BY 1), raw AS (SELECT k, b, c*w AS x FROM tf JOIN idf USING (b)),
  nrm AS (SELECT k, sqrt(sum(x*x)) AS norm FROM raw GROUP BY 1),
  vec AS (SELECT k, string_agg(b||':'||printf('%.6f', round(x/norm,6)), ' ' ORDER BY b) AS vector FROM raw JOIN nrm USING (k) WHERE norm>0 AND round(x/norm,6)<>0 GROUP BY 1)"""


def _shown(c):
    """A vector as text, like the SQL shows it."""
    parts = F.transform(c, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["x"] != 0), lambda p: F.format_string("%d:%.6f", p["i"], p["x"])), " ")


@query("vec_embed", EV + "," + SENT_SQL + ", sid AS (SELECT *, md5(sentence) AS sentence_id FROM sent), us AS (SELECT DISTINCT case_id||'|'||sentence_id AS k0, sentence FROM sid)," + _embed_sql("us", "k0", "sentence") + """
  SELECT case_id, event_id, coalesce(vector,'') AS vector FROM sid LEFT JOIN vec ON vec.k=case_id||'|'||sentence_id""")
def _(spark, d):
    return ve.embed_events(canonical_events(spark, d)).select("case_id", "event_id", _shown("embedding").alias("vector"))


DOT = "list_sum(list_transform(list_zip({a},{b}), lambda z: z[1]::DOUBLE*z[2]::DOUBLE))"
VQ = "qv AS (SELECT label, vec_id AS qid, embedding AS q FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn=1)"


def _vec(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("case_id"), F.col("vec_id").cast("string").alias("id"), "embedding")


def _vec_queries(spark, d):
    first = F.min(F.struct(F.col("id").cast("bigint").alias("n"), F.col("id").alias("query_id"), F.col("embedding").alias("query")))
    return _vec(spark, d).groupBy("case_id").agg(first.alias("m")).select("case_id", "m.query_id", "m.query")


@query("vec_topk", "WITH " + VQ + f""" SELECT query_id, id, round(score,6) AS score, rank FROM (SELECT qid::VARCHAR AS query_id, vec_id::VARCHAR AS id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM
  (SELECT qid, vec_id, {DOT.format(a='embedding', b='q')} AS score FROM embeddings JOIN qv USING (label))) WHERE rank<=10""")
def _(spark, d):
    return ve.topk_in_case(_vec(spark, d), _vec_queries(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("jn_fetch", "WITH " + VQ + f""" SELECT query_id, id, rank, label AS doc_label FROM (SELECT qid::VARCHAR AS query_id, vec_id::VARCHAR AS id, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM
  (SELECT qid, e.vec_id, e.label, round({DOT.format(a='e.embedding', b='qv.q')},9) AS score FROM embeddings e, qv)) WHERE rank<=10""")
def _(spark, d):
    from caselens.operators.joins import fetch_ranked
    q = _vec_queries(spark, d).select("query_id", "query")
    docs = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("doc_label"))
    return fetch_ranked(ve.topk_all(_vec(spark, d), q, 10, block=200, query_block=4), docs, "id").select("query_id", "id", "rank", "doc_label")


@query("vec_similar_cases", "WITH " + VQ + f""" SELECT case_id, similar_case, round(score,4) AS score, rank FROM (SELECT qid::VARCHAR AS case_id, vec_id::VARCHAR AS similar_case, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM
  (SELECT qid, e.vec_id, round({DOT.format(a='e.embedding', b='qv.q')},9) AS score FROM embeddings e, qv WHERE e.vec_id<>qid)) WHERE rank<=5""")
def _(spark, d):
    cases = _vec(spark, d).select(F.col("id").alias("case_id"), "embedding")
    q = _vec_queries(spark, d).select(F.col("query_id").alias("case_id"), F.col("query").alias("embedding"))
    return ve.similar_cases(cases, q)


@query("vec_case_index", EV + "," + EVENT_CASES_SQL + "," + CASE_TEXT_SQL + "," + _embed_sql("ctx", "case_id", "case_text") + """
  SELECT ('0x'||substr(md5(case_id),1,8))::BIGINT AS point_id, case_id, title, status, substr(case_text,1,500) AS summary_text, coalesce(vector,'') AS vector FROM ctx JOIN ecases USING (case_id) LEFT JOIN vec ON vec.k=case_id""")
def _(spark, d):
    ev = canonical_events(spark, d)
    idx = materialize(ve.case_index(event_cases(ev), ev), "case-index")
    return ve.case_index(event_cases(ev), ev, stored=idx).select("point_id", "case_id", "title", "status", "summary_text", _shown("embedding").alias("vector"))


@query("vec_near", """SELECT count(*) FILTER (vec_id%10=0)::BIGINT AS n_queries, (10*count(*) FILTER (vec_id%10=0))::BIGINT AS n_found, true AS recalled FROM embeddings WHERE embedding IS NOT NULL""")
def _(spark, d):
    """Inverted lists over all vectors, probes tuned on one tenth of them, searched for another: recall of 0.9 or more against the exact lists."""
    v = materialize(_vec(spark, d).select("id", "embedding").filter("embedding is not null"), "vectors")
    asked = lambda r: v.filter(F.col("id").cast("bigint") % 10 == r).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    centre = ve.fit_centroids(v, 32)
    lists = materialize(ve.inverted_lists(v, centre), "lists")
    found = materialize(ve.topk_near(lists, centre, asked(0), 10, ve.probes_for(lists, centre, asked(5))), "found")
    told = ve.recall(found, ve.topk_all(v, asked(0), 10)).first()
    return found.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_found")).withColumn("recalled", F.lit(told["hits"] >= 0.9 * told["of"]))
