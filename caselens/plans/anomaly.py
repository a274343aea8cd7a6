"""Anomaly detectors over the canonical events."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.operators import anomaly as an
from caselens.operators import ordered as od
from caselens.plans.registry import query
from caselens.plans.timeline import EV
from caselens.session import materialize
from caselens.sources.adapt import canonical_events

FEAT_SQL = """sz AS (SELECT case_id, count(*) AS n FROM ev GROUP BY 1), ft AS MATERIALIZED (SELECT ev.case_id, event_id, n, hour(ts)::DOUBLE AS x0, CASE WHEN isodow(ts)>=6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x1,
  sn/n::DOUBLE AS x2, obn/n::DOUBLE AS x3, an/n::DOUBLE AS x4, CASE severity WHEN 'info' THEN 0.0::DOUBLE WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 ELSE 1.0 END AS x5
  FROM ev JOIN sz USING (case_id) JOIN (SELECT case_id, subject, count(*) AS sn FROM ev GROUP BY 1,2) USING (case_id, subject)
  JOIN (SELECT case_id, object, count(*) AS obn FROM ev GROUP BY 1,2) USING (case_id, object) JOIN (SELECT case_id, action, count(*) AS an FROM ev GROUP BY 1,2) USING (case_id, action))"""
X = range(6)
HBOS_SQL = FEAT_SQL + ", en AS (SELECT case_id, count(*) AS n, " + ", ".join(f"min(x{i}) AS mn{i}, max(x{i}) AS mx{i}" for i in X) + """ FROM ft GROUP BY 1),
  bn AS (SELECT ft.case_id, event_id, en.n, """ + ", ".join(
    f"CASE WHEN mx{i}>mn{i} THEN (mx{i}-mn{i})/10 ELSE 0.1::DOUBLE END AS w{i}, CASE WHEN mx{i}>mn{i} THEN least(floor((x{i}-mn{i})/((mx{i}-mn{i})/10)),9) ELSE 5 END::INT AS b{i}" for i in X) + """ FROM ft JOIN en USING (case_id)),
  """ + ", ".join(f"h{i} AS (SELECT case_id, b{i}, log2(count(*)/(any_value(n)*any_value(w{i}))+0.1::DOUBLE) AS v{i} FROM bn GROUP BY 1,2)" for i in X) + """,
  hr AS (SELECT case_id, event_id, round(-(0.0::DOUBLE""" + "".join(f"+v{i}" for i in X) + "),9) AS raw FROM bn " + " ".join(f"JOIN h{i} USING (case_id, b{i})" for i in X) + """),
  hs AS (SELECT case_id, event_id, 'hbos' AS model, raw >= quantile_cont(raw, 0.95) OVER (PARTITION BY case_id) AS flag, (raw-min(raw) OVER (PARTITION BY case_id))/(max(raw) OVER (PARTITION BY case_id)-min(raw) OVER (PARTITION BY case_id)) AS score FROM hr)"""
LOF_SQL = FEAT_SQL + """, vec AS MATERIALIZED (SELECT case_id, """ + ", ".join(f"x{i}" for i in X) + """, row_number() OVER () AS vid, count(*) AS w FROM ft GROUP BY case_id, """ + ", ".join(f"x{i}" for i in X) + """),
  pr AS MATERIALIZED (SELECT a.vid, b.vid AS nb, CASE WHEN a.vid=b.vid THEN b.w-1 ELSE b.w END AS nw, round(sqrt(""" + "+".join(f"(a.x{i}-b.x{i})*(a.x{i}-b.x{i})" for i in X) + """),9) AS d FROM vec a JOIN vec b USING (case_id)),
  cu AS (SELECT *, sum(nw) OVER (PARTITION BY vid ORDER BY d) AS cum FROM pr WHERE nw>0),
  kd AS (SELECT vid, min(d) AS kd FROM cu WHERE cum>=10 GROUP BY 1),
  nn AS MATERIALIZED (SELECT pr.*, kd.kd FROM pr JOIN kd USING (vid) WHERE nw>0 AND d<=kd),
  lr AS (SELECT nn.vid, 1.0::DOUBLE/(sum(nw*greatest(kd.kd,d))/sum(nw)+1e-10) AS lrd FROM nn JOIN kd ON kd.vid=nn.nb GROUP BY 1),
  lf AS (SELECT nn.vid, round((sum(nw*b.lrd)/sum(nw))/any_value(a.lrd),6) AS raw FROM nn JOIN lr b ON b.vid=nn.nb JOIN lr a ON a.vid=nn.vid GROUP BY 1),
  le AS (SELECT ft.case_id, event_id, raw FROM ft JOIN vec USING (case_id, """ + ", ".join(f"x{i}" for i in X) + """) JOIN lf USING (vid)),
  ls AS (SELECT case_id, event_id, 'lof' AS model, raw > quantile_cont(raw, 0.95) OVER (PARTITION BY case_id) AS flag, (raw-min(raw) OVER (PARTITION BY case_id))/(max(raw) OVER (PARTITION BY case_id)-min(raw) OVER (PARTITION BY case_id)) AS score FROM le)"""


def _feats(spark, d):
    return materialize(an.features(canonical_events(spark, d)), "features")


@query("ml_features", EV + "," + FEAT_SQL + " SELECT case_id, event_id, x0 AS hour, x1 AS weekend, round(x2,9) AS subject_freq, round(x3,9) AS object_freq, round(x4,9) AS action_freq, x5 AS severity_rank FROM ft")
def _(spark, d):
    f = an.features(canonical_events(spark, d))
    return f.select("case_id", "event_id", "hour", "weekend", *[F.round(c, 9).alias(c) for c in ("subject_freq", "object_freq", "action_freq")], "severity_rank")


@query("ml_small", EV + """, c AS (SELECT *, username2||'_'||CAST(ts AS DATE) AS cid FROM (SELECT *, subject AS username2 FROM ev)), s AS (SELECT cid FROM c GROUP BY 1 HAVING count(*)<5)
  SELECT cid AS case_id, event_id, severity IN ('critical','high','medium') OR techniques<>'' AS flag, CASE WHEN severity IN ('critical','high') THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS score FROM c JOIN s USING (cid)""")
def _(spark, d):
    ev = canonical_events(spark, d)
    return an.small_cases(ev.withColumn("case_id", F.concat_ws("_", "subject", F.date_format("ts", "yyyy-MM-dd"))))


@query("ml_hbos", EV + "," + HBOS_SQL + " SELECT case_id, event_id, model, flag, round(score,6) AS score FROM hs")
def _(spark, d):
    return an.hbos(_feats(spark, d)).withColumn("score", F.round("score", 6))


@query("ml_lof", EV + "," + LOF_SQL + " SELECT case_id, event_id, model, flag, round(score,5) AS score FROM ls")
def _(spark, d):
    return an.lof(_feats(spark, d)).withColumn("score", F.round("score", 5))


@query("win_minmax", EV + "SELECT event_id, round((anomaly_score-mn)/(mx-mn),6) AS up, round(1-(anomaly_score-mn)/(mx-mn),6) AS down FROM ev JOIN (SELECT case_id, min(anomaly_score) AS mn, max(anomaly_score) AS mx FROM ev GROUP BY 1) USING (case_id)")
def _(spark, d):
    ev = canonical_events(spark, d).select("case_id", "event_id", "anomaly_score")
    both = od.min_max(od.min_max(ev, ["case_id"], "anomaly_score", "up"), ["case_id"], "anomaly_score", "down", True)
    return both.select("event_id", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"))


BASE = ("case_0", "case_1")  # the baseline: cases that are not scored
LEVELS = 8


def _path_sql(n: str) -> str:
    return f"CASE WHEN {n}<=1 THEN 0.0::DOUBLE WHEN {n}=2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE*(ln({n}-1.0::DOUBLE)+{0.5772156649015329!r}::DOUBLE)-2.0::DOUBLE*({n}-1.0::DOUBLE)/{n} END"


def _forest_sql() -> str:
    """The trees level by level, as the operator grows them: l<depth> holds the rows of each level with their node's cut."""
    factors = ",".join(f"({t},{f})" for t, f in enumerate(an.tree_factors(an.TREES)))
    cte = [f"""fct(tree_id, f) AS (VALUES {factors}), bs AS (SELECT event_id, x0,x1,x2,x3,x4,x5, ('0x'||substr(md5(event_id),1,8))::BIGINT%{an.PRIME} AS v FROM ft WHERE case_id IN {BASE}),
  sm AS MATERIALIZED (SELECT tree_id, event_id, x0,x1,x2,x3,x4,x5, count(*) OVER (PARTITION BY tree_id) AS size FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY (v*f+tree_id)%{an.PRIME}, event_id) AS rn FROM bs, fct) WHERE rn<={an.TREE_ROWS})"""]
    before = "(SELECT *, 1::BIGINT AS node FROM sm)"
    ends = ",".join(f"min(x{i}) OVER w AS lo{i}, max(x{i}) OVER w AS hi{i}" for i in X)
    pick = "[" + ",".join("{}".format(f"CASE WHEN hi{i}>lo{i} THEN {i} END") for i in X) + "]"
    hexed = lambda k: f"('0x'||substr(md5(tree_id||':'||node),{k},8))::BIGINT"
    for d in range(LEVELS + 1):
        cte.append(f"""s{d} AS (SELECT *, list_filter({pick}, lambda z: z IS NOT NULL) AS op FROM (SELECT tree_id, event_id, size, node, x0,x1,x2,x3,x4,x5, count(*) OVER w AS n, {ends} FROM {before} WINDOW w AS (PARTITION BY tree_id, node))),
  f{d} AS (SELECT *, CASE WHEN {d}>=ceil(log2(greatest(size,2))) OR n<=1 OR len(op)=0 THEN -1 ELSE op[1+{hexed(1)}%len(op)] END AS feature FROM s{d}),
  l{d} AS MATERIALIZED (SELECT tree_id, event_id, size, node, n, feature, x0,x1,x2,x3,x4,x5, CASE WHEN feature<0 THEN 0.0::DOUBLE ELSE [lo0,lo1,lo2,lo3,lo4,lo5][feature+1]+{hexed(9)}/4294967296.0::DOUBLE*([hi0,hi1,hi2,hi3,hi4,hi5][feature+1]-[lo0,lo1,lo2,lo3,lo4,lo5][feature+1]) END AS cut,
   CASE WHEN feature<0 THEN {d}+{_path_sql('n')} ELSE 0.0::DOUBLE END AS path FROM f{d})""")
        before = f"(SELECT *, 2*node+([x0,x1,x2,x3,x4,x5][feature+1]>cut)::BIGINT AS next FROM l{d} WHERE feature>=0)"
        before = f"(SELECT tree_id, event_id, size, next AS node, x0,x1,x2,x3,x4,x5 FROM {before})"
    cte.append("nd AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT DISTINCT tree_id, node AS node_id, feature, cut AS threshold, path, n AS node_rows, size AS n_rows FROM l{d}" for d in range(LEVELS + 1)) + ")")
    return ", ".join(cte)


def _isolation_sql(name: str, rows: str) -> str:
    """Raw values of rows (case_id, event_id, x0..x5) by walking all trees down."""
    cte = [f"{name}0 AS (SELECT case_id, event_id, x0,x1,x2,x3,x4,x5, tree_id, 1::BIGINT AS node FROM {rows}, (SELECT DISTINCT tree_id FROM nd))"]
    for d in range(LEVELS):
        cte.append(f"{name}{d + 1} AS (SELECT case_id, event_id, x0,x1,x2,x3,x4,x5, r.tree_id, CASE WHEN feature<0 THEN node ELSE 2*node+([x0,x1,x2,x3,x4,x5][feature+1]>threshold)::BIGINT END AS node FROM {name}{d} r JOIN nd ON nd.tree_id=r.tree_id AND nd.node_id=r.node)")
    cte.append(f"{name} AS MATERIALIZED (SELECT case_id, event_id, round(pow(2.0::DOUBLE, -(sum(round(path*1e9)::BIGINT)/1e9::DOUBLE)/count(*)/any_value(c)),9) AS raw FROM {name}{LEVELS} r JOIN nd ON nd.tree_id=r.tree_id AND nd.node_id=r.node, cc GROUP BY 1,2)")
    return ", ".join(cte)


FOREST_SQL = _forest_sql()
SCORE_SQL = FOREST_SQL + f""", cc AS (SELECT avg({_path_sql('n_rows')}) AS c FROM nd WHERE node_id=1), {_isolation_sql('tr', "(SELECT DISTINCT 'b' AS case_id, event_id, x0,x1,x2,x3,x4,x5 FROM sm)")},
  {_isolation_sql('rw', f"(SELECT * FROM ft WHERE case_id NOT IN {BASE})")}, ct AS (SELECT round(quantile_cont(raw, 0.95),9) AS cut FROM tr JOIN sm USING (event_id)),
  fs AS (SELECT case_id, event_id, 'isolation_forest' AS model, raw>cut AS flag, (raw-min(raw) OVER (PARTITION BY case_id))/(max(raw) OVER (PARTITION BY case_id)-min(raw) OVER (PARTITION BY case_id)) AS score FROM rw, ct)"""


def _parts(spark, d):
    """Features of the baseline cases and of the others."""
    f = _feats(spark, d)
    base = F.col("case_id").isin(*BASE)
    return f.filter(base), f.filter(~base)


@query("ml_iforest_fit", EV + "," + FEAT_SQL + "," + FOREST_SQL + " SELECT tree_id, node_id, feature, round(threshold,9) AS threshold, round(path,6) AS path, node_rows, n_rows FROM nd")
def _(spark, d):
    forest = an.fit_forest(_parts(spark, d)[0])
    return forest.select("tree_id", "node_id", "feature", F.round("threshold", 9).alias("threshold"), F.round("path", 6).alias("path"), "node_rows", "n_rows")


@query("ml_iforest_score", EV + "," + FEAT_SQL + "," + SCORE_SQL + " SELECT case_id, event_id, model, flag, round(score,6) AS score FROM fs")
def _(spark, d):
    base, rest = _parts(spark, d)
    return an.isolation_forest(rest, materialize(an.fit_forest(base), "trees"), base).withColumn("score", F.round("score", 6))


@query("ml_ensemble", EV + "," + HBOS_SQL + "," + LOF_SQL.replace(FEAT_SQL + ", ", "", 1) + "," + SCORE_SQL + f""", u AS (SELECT * FROM hs UNION ALL SELECT * FROM ls UNION ALL SELECT * FROM fs)
  SELECT case_id, event_id, count(*) FILTER (flag)>=2 AS flag, round(sum(score)/3,5) AS score FROM u WHERE case_id NOT IN {BASE} GROUP BY 1,2""")
def _(spark, d):
    ev = canonical_events(spark, d)
    out = an.detect(ev.filter(~F.col("case_id").isin(*BASE)), baseline=_parts(spark, d)[0])
    return out.select("case_id", "event_id", "flag", F.round("score", 5).alias("score"))
