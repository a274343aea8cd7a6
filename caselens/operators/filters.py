"""Filters over events, edges, cases, evidence, audit rows and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import json_path, strip
from caselens.schema import ACTIVE_STATUSES, SEVERITIES, severity_rank

# Process images left out by ``hide_benign``.
BENIGN = [
    "svchost.exe", "conhost.exe", "lsass.exe", "explorer.exe", "smss.exe", "csrss.exe",
    "services.exe", "wininit.exe", "taskhostw.exe", "searchindexer.exe", "fontdrvhost.exe",
    "dwm.exe", "ctfmon.exe", "spoolsv.exe",
]
# Phrases of a reply that says nothing.
WEAK_PHRASES = [
    "i don't know", "i do not know", "no relevant information", "unable to answer",
    "not enough evidence", "insufficient context", "i cannot answer", "i'm unable",
    "no information found", "cannot determine",
]
FILE_NAME = r"(?i)\b[\w\-. ]+\.(?:sqlite|pcap|pcapng|csv|json|log|txt|zip)\b"


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def contains_ci(col: Column, term: str) -> Column:
    return F.coalesce(F.lower(col).contains(term.lower()), F.lit(False))


def anomalous(flag: Column, score: Column, threshold: float = 0.5) -> Column:
    """``is_anomaly`` or a score above the threshold; NULLs count as no."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(score > threshold, F.lit(False))


def scope(df: DataFrame, case_id: str | None = None, evidence_id: str | None = None) -> DataFrame:
    if case_id is not None:
        df = df.filter(F.col("case_id") == case_id)
    if evidence_id is not None:
        df = df.filter(F.col("evidence_id") == evidence_id)
    return df


def by_severity(df: DataFrame, severity: str) -> DataFrame:
    return df.filter(F.lower("severity") == severity.strip().lower())


def by_type(df: DataFrame, event_type: str) -> DataFrame:
    return df.filter(F.lower("event_type") == event_type.strip().lower())


def by_anomaly(df: DataFrame, wanted: bool) -> DataFrame:
    """True keeps flagged or high-score events; False only drops flagged ones."""
    if wanted:
        return df.filter(anomalous(F.col("is_anomaly"), F.col("anomaly_score")))
    return df.filter(~F.coalesce("is_anomaly", F.lit(False)))


def search(df: DataFrame, term: str) -> DataFrame:
    """Literal case-insensitive substring over ten fields."""
    t = term.strip()
    fields = [F.col(c) for c in ("subject", "action", "object", "source", "event_type")]
    fields += [json_path(F.col("details"), k) for k in ("filename", "process_name", "command_line", "user")]
    in_tech = F.coalesce(
        F.exists("mitre_techniques", lambda x: F.lower(x).contains(t.lower())), F.lit(False)
    )
    return df.filter(any_of([contains_ci(c, t) for c in fields] + [in_tech]))


def select_events(
    df: DataFrame, case_id: str | None = None, severity: str | None = None, event_type: str | None = None,
    term: str | None = None, is_anomaly: bool | None = None,
) -> DataFrame:
    """All timeline filters together; each lands in one scan-level predicate."""
    df = scope(df, case_id)
    if severity and severity.strip():
        df = by_severity(df, severity)
    if event_type and event_type.strip():
        df = by_type(df, event_type)
    if is_anomaly is not None:
        df = by_anomaly(df, is_anomaly)
    if term and term.strip():
        df = search(df, term)
    return df


def basic(df: DataFrame, severity: str | None = None, event_type: str | None = None) -> DataFrame:
    """Exact severity and/or type."""
    if severity:
        df = df.filter(F.col("severity") == severity)
    if event_type:
        df = df.filter(F.col("event_type") == event_type)
    return df


def at_least(col: Column, level: str) -> Column:
    known = F.lower(col).isin(SEVERITIES)
    return F.coalesce(known & (severity_rank(col) >= SEVERITIES.index(level) * 0.25), F.lit(False))


def with_triple(df: DataFrame) -> DataFrame:
    """Subject and object present and not empty."""
    return df.filter((F.col("subject") != "") & (F.col("object") != ""))


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status").isin(ACTIVE_STATUSES))


def cases(df: DataFrame, organization_id: str | None = None, status: str | None = None, term: str | None = None) -> DataFrame:
    if organization_id is not None:
        df = df.filter(F.col("organization_id") == organization_id)
    if status:
        df = df.filter(F.col("status") == status)
    if term and term.strip():
        t = term.lower()
        df = df.filter(contains_ci(F.col("title"), t) | contains_ci(F.col("description"), t))
    return df


def audit(df: DataFrame, organization_id: str | None = None, case_id: str | None = None, term: str | None = None) -> DataFrame:
    """Audit rows of an organization and case (as entity or in the metadata), with text search."""
    if organization_id is not None:
        df = df.filter(F.col("organization_id") == organization_id)
    if case_id is not None:
        df = df.filter((F.col("entity_id") == case_id) | (json_path(F.col("metadata"), "case_id") == case_id))
    if term and term.strip():
        cols = [F.col("action"), F.col("entity_type"), json_path(F.col("metadata"), "filename"),
                F.col("actor_id"), F.col("self_hash")]
        df = df.filter(any_of([contains_ci(c, term) for c in cols]))
    return df


def is_weak_reply(text: Column) -> Column:
    t = F.lower(strip(text))
    return F.coalesce(
        (F.length(strip(text)) < 50) | any_of([t.contains(p) for p in WEAK_PHRASES]), F.lit(True)
    )


def mentioned_files(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_NAME), 0))


def drop_stale_turns(turns: DataFrame, files: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Drop assistant turns that name a file which the case no longer has.

    Only the mentions are joined with the file table (``key``, ``filename``);
    a turn is stale when one of its mentions finds no file.
    """
    hits = (
        turns.filter(F.col("role") == "assistant")
        .select(key, "turn", F.explode(mentioned_files(F.col(text))).alias("filename"))
    )
    stale = hits.join(files.select(key, "filename").distinct(), [key, "filename"], "left_anti")
    return turns.join(stale.select(key, "turn").distinct(), [key, "turn"], "left_anti")
