"""Canonical event columns and the fixed value domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The enumerations of the data model.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
EVENT_TYPES = [
    "process_creation", "network_connection", "file_modification", "registry_change",
    "auth_event", "browser_history", "browser_download", "browser_credential",
    "hash_record", "csv", "json", "generic",
]
ACTIVE_STATUSES = [
    "uploaded", "queued", "parsing", "processing", "analyzing", "building_graph", "correlating",
]

# Sub-objects (host, user, process, file, network, ...) are flattened, so that a
# query reads only the parquet columns it names.
EVENT_COLUMNS = {
    "event_id": "string", "case_id": "string", "evidence_id": "string", "organization_id": "string",
    "ts": "timestamp_ntz", "event_type": "string", "source": "string", "severity": "string",
    "subject": "string", "action": "string", "object": "string", "description": "string",
    "hostname": "string", "host_ip": "string",
    "username": "string", "user_domain": "string",
    "process_name": "string", "process_path": "string", "pid": "bigint", "ppid": "bigint",
    "command_line": "string", "process_hash": "string",
    "parent_process_name": "string", "parent_pid": "bigint",
    "file_name": "string", "file_path": "string",
    "file_md5": "string", "file_sha1": "string", "file_sha256": "string",
    "source_ip": "string", "source_port": "bigint",
    "destination_ip": "string", "destination_port": "bigint",
    "protocol": "string", "domain": "string", "dns_query": "string", "url": "string",
    "direction": "string", "registry_key": "string", "service_name": "string",
    "details": "string", "mitre_techniques": "array<string>",
    "is_anomaly": "boolean", "anomaly_score": "double", "processed_at": "timestamp_ntz",
    "source_file": "string", "line_number": "bigint",
    "confidence": "double", "extraction_method": "string",
}


def conform(df: DataFrame) -> DataFrame:
    """Project to the canonical columns; absent ones become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()
    ])


def severity_rank(col: Column) -> Column:
    """info 0.0, low 0.25, medium 0.5, high 0.75, critical 1.0; anything else 0."""
    low = F.lower(col)
    rank = F.lit(0.0)
    for i, name in enumerate(SEVERITIES):
        rank = F.when(low == name, F.lit(i * 0.25)).otherwise(rank)
    return rank


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])
