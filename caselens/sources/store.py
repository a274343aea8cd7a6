"""Table writes: append, idempotent replace, cascading delete, report bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators.graph import delete_evidence
from caselens.operators.joins import orphan_nodes

SCOPE = ["case_id", "evidence_id"]


def _spread(events: DataFrame) -> DataFrame:
    """Group rows by folder; ``rebalance`` lets AQE cut a hot folder into tasks of the advisory size."""
    return events.hint("rebalance", *SCOPE).sortWithinPartitions(*SCOPE, "ts")


def append_events(events: DataFrame, path: str) -> None:
    """Rows land in their (case, evidence) folder, sorted by time for tight statistics."""
    _spread(events).write.mode("append").partitionBy(*SCOPE).parquet(path)


def replace_events(events: DataFrame, path: str) -> None:
    """Replace exactly the (case, evidence) folders present in ``events``: running twice equals running once."""
    _spread(events).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCOPE).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cascade(
    tables: dict[str, DataFrame], doomed: DataFrame, evidence: DataFrame,
) -> dict[str, DataFrame]:
    """Delete evidence files (case_id, evidence_id) from every table.

    events and vectors by scope, reports by case, edges and nodes by evidence;
    then orphan nodes, and all nodes of a case with no evidence left. The audit
    table is never touched: it stays a verifiable chain.
    """
    out = dict(tables)
    for name in ("events", "vectors"):
        if name in tables:
            out[name] = tables[name].join(doomed, SCOPE, "left_anti")
    if "reports" in tables:
        out["reports"] = tables["reports"].join(doomed.select("case_id").distinct(), "case_id", "left_anti")
    out["evidence"] = evidence.join(doomed, SCOPE, "left_anti")
    if "nodes" in tables:
        nodes, edges = delete_evidence(tables["nodes"], tables["edges"], doomed)
        tagged = doomed.select(F.col("case_id"), F.col("evidence_id"))
        edges = edges.join(tagged, SCOPE, "left_anti")
        hit = doomed.select("case_id").distinct()
        lost = orphan_nodes(nodes.join(hit, "case_id", "left_semi"), edges).select("node_id")
        empty = hit.join(out["evidence"].select("case_id").distinct(), "case_id", "left_anti")
        out["nodes"] = nodes.join(lost, "node_id", "left_anti").join(empty, "case_id", "left_anti")
        out["edges"] = edges.join(empty, "case_id", "left_anti")
    return out


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object per case; times keep their microseconds, which the default format drops."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    reports.write.mode("overwrite").options(timestampNTZFormat=micros, timestampFormat=micros + "XXX").json(path)
