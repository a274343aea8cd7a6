"""Streaming operators, each run once over the driver's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions.when import micros
from caselens.plans.registry import query
from caselens.plans.timeline import EV, EVID
from caselens.operators.ordered import sessions
from caselens.session import materialize, scratch_path
from caselens.sources.adapt import table, to_canonical
from caselens.streaming import streams as st


def _events(spark, d):
    return st.file_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")


def _parts(spark, d, name, n=3, columns=("*",)):
    """The columns of a table in n micro-batches without order in time, each of as many files as a large table has tasks."""
    path, rows = scratch_path(spark, name), table(spark, d, name).select(*columns)
    each = -(-rows.rdd.getNumPartitions() // n)
    rows.repartition(n * each).write.parquet(path)
    return st.file_stream(spark, path, rows.schema, per_trigger=each)


@query("st_ingest", EV + "SELECT case_id, source, count(*) AS n, max(ts) AS last_ts FROM ev GROUP BY 1,2")
def _(spark, d):
    out = scratch_path(spark, "ingest")
    st.ingest(_events(spark, d), to_canonical, out, scratch_path(spark, "ingest-check")).awaitTermination()
    return spark.read.parquet(out).groupBy("case_id", "source").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("st_dedupe", "SELECT DISTINCT 'case_'||(o_custkey%50) AS case_id, sha256(CAST(o_orderkey%400 AS VARCHAR)) AS sha256 FROM orders")
def _(spark, d):
    raw = _parts(spark, d, "orders")
    files = raw.select(F.concat(F.lit("case_"), (F.col("o_custkey") % 50).cast("string")).alias("case_id"),
                       F.sha2((F.col("o_orderkey") % 400).cast("string"), 256).alias("sha256"), F.col("o_orderdate").alias("created_at"))
    store = scratch_path(spark, "held")
    st.dedupe(files, store, scratch_path(spark, "dedupe-check")).awaitTermination()
    return spark.read.schema(files.schema).parquet(store).select("case_id", "sha256")


@query("st_sessions", EV + """SELECT case_id, start_ts, end_ts, event_count FROM (SELECT case_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS event_count FROM (
  SELECT case_id, ts, sum(CASE WHEN gap > INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT *, ts - lag(ts) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS gap FROM ev)) GROUP BY case_id, s) WHERE end_ts + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)""")
def _(spark, d):
    out = st.run_once(st.sessions(to_canonical(_events(spark, d))), "append", "sessions")
    return out.select("case_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "event_count")


@query("st_stats", EV + """SELECT case_id, evidence_id, count(*) AS total, count(*) FILTER (is_anomaly OR anomaly_score>0.5) AS anomalies,
  count(*) FILTER (severity IN ('critical','high')) AS critical FROM ev GROUP BY 1,2""")
def _(spark, d):
    return st.run_once(st.counters(to_canonical(_events(spark, d))), "complete", "stats")


@query("st_bruteforce", EV + """, w AS (SELECT destination_ip AS ip, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(4*i) AS start_ts FROM ev, range(6) r(i) WHERE destination_ip IS NOT NULL)
  SELECT ip, start_ts, start_ts + INTERVAL 24 HOUR AS end_ts, count(*) AS failures FROM w GROUP BY 1,2 HAVING count(*)>=3 AND start_ts + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev WHERE destination_ip IS NOT NULL)""")
def _(spark, d):
    ev = to_canonical(_events(spark, d)).filter("destination_ip is not null").select(F.col("destination_ip").alias("ip"), "ts")
    out = st.run_once(st.brute_force(ev, 3, "24 hours", "4 hours"), "append", "bruteforce")
    return out.select("ip", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "failures")


STATUS_SQL = """ch AS (SELECT 'ev_'||l_orderkey AS evidence_id, (['queued','parsing','processing','parsed','correlating','failed','uploaded'])[l_linenumber] AS status, epoch_us(l_shipdate) + l_linenumber AS t_us FROM lineitem),
  s AS (SELECT evidence_id, arg_max(status, t_us) AS status, max(t_us) FILTER (status='parsing') AS st, max(t_us) FILTER (status IN ('parsed','failed')) AS en FROM ch GROUP BY 1)
  SELECT evidence_id, status, st AS started_us, CASE WHEN st IS NULL OR en>=st THEN en END AS finished_us, CASE WHEN en>=st THEN (en-st)//1000 END AS scan_ms FROM s"""


def _changes(raw):
    names = F.array(*[F.lit(x) for x in ("queued", "parsing", "processing", "parsed", "correlating", "failed", "uploaded")])
    return raw.select(F.concat(F.lit("ev_"), F.col("l_orderkey").cast("string")).alias("evidence_id"),
                      F.get(names, (F.col("l_linenumber") - 1).cast("int")).alias("status"), (micros(F.col("l_shipdate")) + F.col("l_linenumber")).alias("at_us"))


@query("st_status", "WITH " + STATUS_SQL)
def _(spark, d):
    out = st.run_once(st.status_stream(_changes(_parts(spark, d, "lineitem", columns=("l_orderkey", "l_linenumber", "l_shipdate")))), "update", "status")
    # each micro-batch tells of the files it changed; the last word on a file is the one with most known
    last = out.groupBy("evidence_id").agg(F.max(F.struct("batch", "status", "started_us", "finished_us", "scan_ms")).alias("s"))
    return last.select("evidence_id", "s.status", "s.started_us", "s.finished_us", "s.scan_ms")


@query("win_latest_status", "WITH " + STATUS_SQL)
def _(spark, d):
    return st.latest_status(_changes(table(spark, d, "lineitem")))


def _routed(spark, d):
    """Events in files without order in time, parted by a watermark of one hour."""
    out = scratch_path(spark, "routed")
    raw = to_canonical(_parts(spark, d, "events", 4))
    st.route_late(raw.select("case_id", "event_id", "ts", "destination_ip"), out, scratch_path(spark, "routed-check")).awaitTermination()
    schema = "case_id string, event_id string, ts timestamp_ntz, destination_ip string, batch bigint"
    return [spark.read.schema(schema).parquet(f"{out}/{name}") for name in ("accepted", "late")]


@query("st_repair_sessions", EV + """SELECT case_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS event_count FROM (
  SELECT case_id, ts, sum(CASE WHEN gap > INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT *, ts - lag(ts) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS gap FROM ev)) GROUP BY case_id, s""")
def _(spark, d):
    """Sessions of the rows in time, then brought up to date with the late rows of each micro-batch: as if all had come in time."""
    accepted, late = _routed(spark, d)
    now = sessions(accepted, ["case_id"]).select("case_id", "start_ts", "end_ts", "event_count")
    for r in late.select("batch").distinct().orderBy("batch").collect():
        now = materialize(st.repair_sessions(now, late.filter(F.col("batch") == r.batch)), "repaired")
    return now


@query("st_repair_windows", EV + """, w AS (SELECT destination_ip AS ip, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(4*i) AS start_ts FROM ev, range(6) r(i) WHERE destination_ip IS NOT NULL)
  SELECT ip, start_ts, count(*) AS failures FROM w GROUP BY 1,2""")
def _(spark, d):
    accepted, late = (x.filter("destination_ip is not null").select(F.col("destination_ip").alias("ip"), "ts") for x in _routed(spark, d))
    stored = materialize(st.window_counts(accepted, "24 hours", "4 hours"), "windows")
    out = st.repair_counts(stored, st.window_counts(late, "24 hours", "4 hours"), ["ip", "start_ts"], ["failures"])
    return out.select("ip", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "failures")
