"""Joins between evidence, events, audit rows, users and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.when import micros


def visits_with_urls(visits: DataFrame, urls: DataFrame, visit_key: str, url_key: str = "id") -> DataFrame:
    """One row per visit with the page it refers to."""
    return visits.join(urls, visits[visit_key] == urls[url_key], "inner").drop(urls[url_key])


def with_actor(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Actor name and mail: user name, else mail; unknown is Investigator, missing is System."""
    u = users.select(
        F.col("user_id").alias("actor_id"),
        F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("email"), F.lit("Investigator")).alias("_name"),
        F.coalesce("email", F.lit("")).alias("_email"),
    )
    fallback = F.when(F.coalesce(F.col("actor_id"), F.lit("")) != "", "Investigator").otherwise("System")
    return (
        audit.join(u, "actor_id", "left")
        .withColumn("actor_name", F.coalesce("_name", fallback))
        .withColumn("actor_email", F.coalesce("_email", F.lit("")))
        .drop("_name", "_email")
    )


def around_target(events: DataFrame, targets: DataFrame, minutes: int = 5, ts: str = "ts") -> DataFrame:
    """Events within +-minutes of their case's target time.

    Times are cut into buckets as wide as the window, so only three buckets per
    target are joined before the exact test.
    """
    width = minutes * 60 * 1_000_000
    b = F.floor(micros(F.col(ts)) / width)
    t = targets.select("case_id", F.col("target_ts")).withColumn("_tb", F.floor(micros(F.col("target_ts")) / width))
    t = t.withColumn("_bucket", F.explode(F.sequence(F.col("_tb") - 1, F.col("_tb") + 1))).drop("_tb")
    near = F.abs(micros(F.col(ts)) - micros(F.col("target_ts"))) <= width
    return events.withColumn("_bucket", b).join(t, ["case_id", "_bucket"]).filter(near).drop("_bucket")


def with_scores(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Write model scores back; events without a score keep theirs."""
    s = scores.select("event_id", F.col("flag").alias("_flag"), F.col("score").alias("_score"))
    return (
        events.join(s, "event_id", "left")
        .withColumn("is_anomaly", F.coalesce("_flag", "is_anomaly"))
        .withColumn("anomaly_score", F.coalesce("_score", "anomaly_score"))
        .drop("_flag", "_score")
    )


def fetch_ranked(ranked: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Documents of ranked ids; the rank is kept."""
    return ranked.join(docs, key)


def new_files(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content the case does not hold yet."""
    return incoming.join(stored.select("case_id", "sha256"), ["case_id", "sha256"], "left_anti")


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_anti")


def with_event_counts(evidence: DataFrame, events: DataFrame) -> DataFrame:
    n = events.groupBy("case_id", "evidence_id").agg(F.count("*").alias("event_count"))
    return evidence.join(n, ["case_id", "evidence_id"], "left").withColumn(
        "event_count", F.coalesce("event_count", F.lit(0))
    )


def in_organization(df: DataFrame, cases: DataFrame, organization_id: str) -> DataFrame:
    """Keep rows whose case belongs to the organization."""
    own = cases.filter(F.col("organization_id") == organization_id).select("case_id")
    return df.join(own, "case_id", "left_semi")
