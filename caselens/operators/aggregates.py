"""Aggregations over events, edges, findings, cases and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.mitre import HIGH_RISK_TACTICS
from caselens.operators.filters import anomalous
from caselens.operators.ordered import top_n


def stats(events: DataFrame) -> DataFrame:
    """total, processed, anomalies and critical+high, per case and per evidence file.

    One pass aggregates by file; the case rows are summed from the file rows, so
    the two scopes always agree.
    """
    per_file = events.groupBy("case_id", "evidence_id").agg(
        F.count("*").alias("total"),
        F.count("processed_at").alias("total_processed"),
        F.count_if(anomalous(F.col("is_anomaly"), F.col("anomaly_score"))).alias("anomalies"),
        F.count_if(F.lower("severity").isin("critical", "high")).alias("critical"),
    )
    names = ["total", "total_processed", "anomalies", "critical"]
    return per_file.groupingSets(
        [[F.col("case_id")], [F.col("case_id"), F.col("evidence_id")]], "case_id", "evidence_id"
    ).agg(*[F.sum(n).alias(n) for n in names])


def frequency(events: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Count of each value and its share of the group."""
    counts = events.groupBy(*by, column).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).withColumn("freq", F.col("n") / F.col("total"))


def degree(edges: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct in, out and total degree of every node per case.

    Edges are unique rows, so counting ends needs one shuffle on the node id.
    """
    ends = edges.select(
        "case_id",
        F.explode(F.array(
            F.struct(F.col("src").alias("node_id"), F.col("src_label").alias("label"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("node_id"), F.col("dst_label").alias("label"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("e"),
    )
    out = ends.groupBy("case_id", F.col("e.node_id").alias("node_id"), F.col("e.label").alias("label")).agg(
        F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree")
    ).withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))
    if top is None:
        return out
    return top_n(out, ["case_id"], [F.desc("total_degree"), F.asc("node_id")], top)


def hotspots(edges: DataFrame, top: int = 10) -> DataFrame:
    out = edges.filter("is_anomaly").groupBy("case_id", F.col("src").alias("node_id"), F.col("src_label").alias("label")).agg(
        F.count("*").alias("anomaly_edge_count")
    )
    return top_n(out, ["case_id"], [F.desc("anomaly_edge_count"), F.asc("node_id")], top)


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("case_id", "label").agg(F.count("*").alias("n"))


def action_counts(edges: DataFrame, top: int = 15) -> DataFrame:
    out = edges.groupBy("case_id", "rel_type").agg(F.count("*").alias("n"))
    return top_n(out, ["case_id"], [F.desc("n"), F.asc("rel_type")], top)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The four structural metrics in one long table."""
    def part(df: DataFrame, metric: str, key: str, value: str) -> DataFrame:
        return df.select("case_id", F.lit(metric).alias("metric"), F.col(key).alias("key"), F.col(value).alias("value"))

    return (
        part(degree(edges, 10), "degree", "node_id", "total_degree")
        .unionByName(part(hotspots(edges), "hotspot", "node_id", "anomaly_edge_count"))
        .unionByName(part(type_counts(nodes), "type", "label", "n"))
        .unionByName(part(action_counts(edges), "action", "rel_type", "n"))
    )


def collapse_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges become one row: count, earliest properties, any anomaly."""
    return edges.groupBy("case_id", "src", "src_label", "dst", "dst_label", "rel_type").agg(
        F.count("*").alias("edge_count"),
        F.min(F.struct("ts", "event_id", "evidence_id")).alias("_first"),
        F.bool_or(F.coalesce("is_anomaly", F.lit(False))).alias("is_anomaly"),
        F.max("anomaly_score").alias("anomaly_score"),
    ).select("*", F.col("_first.event_id").alias("event_id"), F.col("_first.evidence_id").alias("evidence_id")).drop("_first")


def case_status(cases: DataFrame, by: list[str]) -> DataFrame:
    names = ["open", "in_progress", "suspended", "resolved"]
    return cases.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in names]
    )


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("case_id", "rule").agg(F.count("*").alias("n"), F.max("score").alias("max_score"))


def severity_counts(events: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("severity", F.lit("info")))
    return events.filter("is_anomaly").groupBy("case_id", low.alias("severity")).agg(F.count("*").alias("n"))


def technique_set(anomalies: DataFrame) -> DataFrame:
    """Distinct techniques per case."""
    return anomalies.select("case_id", F.explode("mitre_techniques").alias("technique_id")).distinct()


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by label, edges by type, cases seen, and rows lacking a case id."""
    def part(df: DataFrame, kind: str, key: str) -> DataFrame:
        per_case = df.groupBy(F.col(key).alias("key"), "case_id").agg(F.count("*").alias("n"))
        return per_case.groupBy("key").agg(
            F.sum("n").alias("n"), F.count("case_id").alias("cases"),
            F.coalesce(F.sum(F.when(F.col("case_id").isNull(), F.col("n"))), F.lit(0)).alias("without_case"),
        ).withColumn("kind", F.lit(kind))

    return part(nodes, "node", "label").unionByName(part(edges, "edge", "rel_type"))


def reconcile(events: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Event table against graph, per case, with a verdict."""
    ev = events.groupBy("case_id").agg(F.count("*").alias("event_rows"))
    no = nodes.groupBy("case_id").agg(F.count("*").alias("graph_nodes"))
    ed = edges.groupBy("case_id").agg(F.count("*").alias("graph_edges"))
    out = ev.join(no, "case_id", "full").join(ed, "case_id", "full").na.fill(0)
    return out.withColumn(
        "verdict",
        F.when((F.col("graph_nodes") == 0) & (F.col("graph_edges") == 0) & (F.col("event_rows") > 0), "mismatch")
        .when((F.col("graph_nodes") > 0) & (F.col("graph_edges") == 0), "isolated")
        .when((F.col("graph_nodes") == 0) & (F.col("event_rows") == 0), "empty")
        .when(F.col("graph_edges") > 0, "ok").otherwise("unknown"),
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 60, "critical").when(score >= 30, "high")
        .when(score >= 10, "elevated").otherwise("low")
    )


def risk(anomalies: DataFrame, findings: DataFrame, techniques: DataFrame) -> DataFrame:
    """15 per high anomaly, 10 per finding, 20 per high-risk technique, capped at 100."""
    strong = F.coalesce(F.col("anomaly_score") > 0.6, F.lit(False)) | F.col("severity").isin("critical", "high")
    a = anomalies.groupBy("case_id").agg(F.count_if(strong).alias("high_anomalies"))
    f = findings.groupBy("case_id").agg(F.count("*").alias("findings"))
    t = techniques.groupBy("case_id").agg(F.count_if(F.col("tactic").isin(HIGH_RISK_TACTICS)).alias("risky_techniques"))
    out = a.join(f, "case_id", "full").join(t, "case_id", "full").na.fill(0)
    raw = F.col("high_anomalies") * 15 + F.col("findings") * 10 + F.col("risky_techniques") * 20
    return out.withColumn("level", risk_level(raw)).withColumn("score", F.least(raw, F.lit(100)))


def largest_file(evidence: DataFrame) -> DataFrame:
    """Largest file of each case, with the number and total size of its files."""
    pick = F.max(F.struct("size_bytes", "evidence_id", "filename"))
    return evidence.groupBy("case_id").agg(
        pick.alias("_m"), F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes")
    ).select("case_id", F.col("_m.filename").alias("filename"), F.col("_m.size_bytes").alias("size_bytes"), "files", "total_bytes")


def parsed_count(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("case_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "parsed").alias("parsed")
    )


def extract_totals(events_with_arrays: DataFrame) -> DataFrame:
    """Entities and relationships found in each file."""
    return events_with_arrays.groupBy("case_id", "evidence_id").agg(
        F.count("*").alias("events"), F.sum(F.size("entities")).cast("bigint").alias("entities"),
        F.sum(F.size("relationships")).cast("bigint").alias("relationships"),
    )
