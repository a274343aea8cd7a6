"""Case graph, its eight views, and node risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.operators.filters import BENIGN, anomalous, any_of, at_least, contains_ci

# Relation types of each view.
VIEW_RELATIONS = {
    "process_tree": ["SPAWNED", "EXECUTED", "INVOLVES_PROCESS", "OCCURRED_ON", "INVOLVES_USER"],
    "attack_path": ["SPAWNED", "CONNECTED_TO", "RESOLVED", "MODIFIED_REGISTRY", "EXECUTED", "CREATED"],
    "network": ["CONNECTED_TO", "RESOLVED", "RESOLVES_TO", "USES_PORT", "VISITED_DOMAIN", "CONTAINS_VISIT"],
    "browser": ["VISITED_DOMAIN", "CONTAINS_VISIT"],
    "registry": ["MODIFIED_REGISTRY", "MODIFIED", "INVOLVES_REGISTRY"],
    "auth": ["INVOLVES_USER", "EXECUTED", "OCCURRED_ON", "LOGGED_IN"],
}
# Process images that open the attack path view.
ATTACK_IMAGES = [
    "powershell.exe", "cmd.exe", "wmic.exe", "mshta.exe", "schtasks.exe", "regsvr32.exe", "certutil.exe",
]
VIEWS = ["entity", *VIEW_RELATIONS, "ioc"]
SEARCHABLE = ["Process", "User", "Host", "IPAddress", "Domain", "RegistryKey", "File"]

# Label words, technique, suspicious level; the first match wins.
PROCESS_RISK = [
    (["powershell"], "T1059.001", "high"),
    (["cmd"], "T1059.003", "medium"),
    (["wmic"], "T1047", "high"),
    (["schtasks.exe", "at.exe"], "T1053.005", "high"),
    (["mshta.exe", "regsvr32.exe", "rundll32.exe"], "T1218", "critical"),
    (["certutil.exe", "bitsadmin.exe"], "T1105", "critical"),
    (["reg.exe"], "T1112", "medium"),
    (["net.exe", "net1.exe"], "T1087", "medium"),
]
RUN_KEY_WORDS = ["run", "runonce", "winlogon", "startup"]


def with_risk(nodes: DataFrame) -> DataFrame:
    """Technique, suspicious flag and risk level of each node."""
    low, label = F.lower(F.coalesce("name", F.lit(""))), F.col("label")
    tech: Column = F.lit(None).cast("string")
    level: Column = F.lit("low")
    rules = [(label == "RegistryKey", RUN_KEY_WORDS, "T1547.001", "high")]
    rules += [(label == "Process", w, t, lv) for w, t, lv in reversed(PROCESS_RISK)]
    for is_kind, words, t, lv in rules:
        hit = is_kind & any_of([low.contains(w) for w in words])
        tech = F.when(hit, F.lit(t)).otherwise(tech)
        level = F.when(hit, F.lit(lv)).otherwise(level)
    public = (label == "IPAddress") & ~F.coalesce("is_private", F.lit(False))
    tech = F.when(public, "T1071").when(label == "Domain", "T1568").otherwise(tech)
    level = F.when(public, "medium").when(label == "Domain", "info").otherwise(level)
    suspicious = (tech.isNotNull() & (label != "Domain"))
    score = F.coalesce("anomaly_score", F.lit(0.0))
    top = F.coalesce("is_anomaly", F.lit(False)) | (score > 0.75)
    return (
        nodes.withColumn("technique_id", tech)
        .withColumn("risk_level", F.when(top, "critical")
                    .when((score > 0.5) & ~level.isin("critical", "high"), "high").otherwise(level))
        .withColumn("suspicious", top | (score > 0.5) | suspicious)
    )


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Join the attributes of both ends as ``s_*`` and ``d_*`` columns."""
    def end(p: str, key: str) -> DataFrame:
        return nodes.select(
            F.col("node_id").alias(key), F.col("name").alias(p + "name"), F.col("severity").alias(p + "severity"),
            F.col("evidence_id").alias(p + "evidence"), F.col("is_anomaly").alias(p + "anomaly"),
            F.col("anomaly_score").alias(p + "score"), F.col("case_id").alias(p + "case"),
        )

    return edges.join(end("s_", "src"), "src").join(end("d_", "dst"), "dst")


def end_anomalous(threshold: float = 0.5) -> Column:
    """Edge or either end is anomalous."""
    return (
        anomalous(F.col("is_anomaly"), F.col("anomaly_score"), threshold)
        | anomalous(F.col("s_anomaly"), F.col("s_score"), threshold)
        | anomalous(F.col("d_anomaly"), F.col("d_score"), threshold)
    )


def either(test) -> Column:
    """A test of (prefix) on the source end or on the target end."""
    return test("s_") | test("d_")


def touches_benign() -> Column:
    return either(lambda p: F.coalesce(F.lower(p + "name").isin(BENIGN), F.lit(False)))


def in_evidence(evidence_id: str) -> Column:
    same = [F.col(c) == evidence_id for c in ("evidence_id", "s_evidence", "d_evidence")]
    return any_of([F.coalesce(t, F.lit(False)) for t in same])


def severity_at_least(level: str) -> Column:
    return either(lambda p: at_least(F.col(p + "severity"), level))


def label_matches(term: str) -> Column:
    def test(p: str) -> Column:
        kind = F.col("src_label" if p == "s_" else "dst_label")
        return kind.isin(SEARCHABLE) & contains_ci(F.col(p + "name"), term)

    return either(test)


def _compact(edges: DataFrame) -> DataFrame:
    """Collapse edges that every filter treats alike, before the node joins."""
    return edges.groupBy(
        "case_id", "src", "src_label", "dst", "dst_label", "rel_type", "evidence_id",
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"), "anomaly_score",
    ).agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))


def case_graph(
    nodes: DataFrame, edges: DataFrame, case_id: str | None = None, evidence_id: str | None = None,
    anomaly_only: bool = False, limit: int | None = None,
) -> DataFrame:
    """Edges of a case (edge or either end belongs to it) with both ends' attributes."""
    rows = with_ends(edges, nodes)
    if case_id is not None:
        rows = rows.filter(any_of([F.coalesce(F.col(c) == case_id, F.lit(False)) for c in ("case_id", "s_case", "d_case")]))
    if evidence_id is not None:
        rows = rows.filter(in_evidence(evidence_id))
    if anomaly_only:
        rows = rows.filter(end_anomalous())
    if limit is not None:
        rows = rows.orderBy("src", "dst", "rel_type", "event_id", "ts").limit(limit)
    return rows


def _edge_of(name: str) -> Column:
    """What a view asks of an edge itself."""
    labels = [F.col("src_label"), F.col("dst_label")]
    tests = [F.col("rel_type").isin(VIEW_RELATIONS[name])] if name in VIEW_RELATIONS else []
    if name == "entity":
        tests += [~x.isin("Event", "Case") for x in labels]
    if name == "registry":
        tests.append((labels[0] == "RegistryKey") | (labels[1] == "RegistryKey"))
    if name == "auth":
        tests.append(labels[0].isin("User", "Host") | labels[1].isin("User", "Host"))
    return reduce(Column.__and__, tests, F.lit(True))


def _ends_of(name: str) -> Column:
    """What a view asks of the attributes of an edge's ends."""
    if name == "attack_path":
        return end_anomalous(0.4) | either(lambda p: F.coalesce(F.lower(p + "name").isin(ATTACK_IMAGES), F.lit(False)))
    return end_anomalous() if name == "ioc" else F.lit(True)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "case_id", "src", "src_label", "dst", "dst_label", "rel_type").agg(
        F.sum("n").alias("edge_count"), F.bool_or("is_anomaly").alias("is_anomaly"),
        F.substring(F.any_value("s_name"), 1, 80).alias("src_name"),
        F.substring(F.any_value("d_name"), 1, 80).alias("dst_name"),
    )


def all_views(nodes: DataFrame, edges: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Several views at once, told apart by ``view``: ends are joined once and edges summed once."""
    wanted = names or VIEWS
    mine = F.array_compact(F.array(*[F.when(F.coalesce(_edge_of(v) & _ends_of(v), F.lit(False)), F.lit(v)) for v in wanted]))
    rows = with_ends(_compact(edges), nodes)
    return _summed(rows.withColumn("view", F.explode(mine)), "view")


def view(
    nodes: DataFrame, edges: DataFrame, name: str = "entity", *, case_id: str | None = None,
    evidence_id: str | None = None, anomaly_only: bool = False, hide_benign: bool = False,
    severity: str | None = None, term: str | None = None, limit: int | None = None,
) -> DataFrame:
    """One of the eight aggregated views: an edge row per (source, target, type)."""
    if name not in VIEWS:
        name = "entity"
    if case_id is not None:
        edges = edges.filter(F.col("case_id") == case_id)
        nodes = nodes.filter(F.col("case_id") == case_id)
    rows = with_ends(_compact(edges.filter(_edge_of(name))), nodes).filter(_ends_of(name))
    if anomaly_only:
        rows = rows.filter(end_anomalous())
    if evidence_id is not None:
        rows = rows.filter(in_evidence(evidence_id))
    if hide_benign:
        rows = rows.filter(~touches_benign())
    if severity:
        rows = rows.filter(severity_at_least(severity))
    if term:
        rows = rows.filter(label_matches(term))
    out = _summed(rows)
    return out if limit is None else out.orderBy("src", "dst", "rel_type").limit(limit)


def view_nodes(nodes: DataFrame, view_edges: DataFrame) -> DataFrame:
    """Nodes of a view with their risk."""
    used = view_edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return with_risk(nodes.join(used, "node_id", "left_semi"))
