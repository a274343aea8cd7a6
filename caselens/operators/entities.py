"""Entities and relationships observed in single events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.network import is_private_ip
from caselens.schema import first_filled


def _s(c: Column) -> Column:
    return c.cast("string")


def _parts() -> dict[str, Column]:
    host = first_filled(F.col("hostname"), F.lit("host"))
    user = F.when(
        F.col("username") != "",
        F.concat_ws("\\", F.when(F.col("user_domain") != "", F.col("user_domain")), F.col("username")),
    )
    proc = F.when(
        F.col("process_name") != "",
        F.concat_ws(":", host, _s(F.coalesce("pid", F.lit(0))), F.col("process_name")),
    )
    parent = F.when(
        (F.col("parent_process_name") != "") & proc.isNotNull(),
        F.concat_ws(":", host, _s(F.coalesce("parent_pid", F.lit(0))), F.col("parent_process_name")),
    )
    ip = first_filled(F.col("destination_ip"), F.col("source_ip"))
    port = F.when(ip.isNotNull() & (F.col("destination_port") != 0), F.concat(_s(F.col("destination_port")), F.lit(":TCP")))
    svc = F.when(F.col("service_name") != "", F.concat_ws(":", host, F.col("service_name")))
    act = F.lower(F.coalesce("action", F.lit("")))
    file_rel = (
        F.when(act.contains("create") | act.contains("write"), "CREATED")
        .when(act.contains("delete") | act.contains("remove"), "DELETED").otherwise("MODIFIED")
    )
    return {
        "event": F.col("event_id"), "host": F.when(F.col("hostname") != "", F.col("hostname")), "user": user,
        "proc": proc, "parent": parent, "ip": ip, "port": port,
        "domain": first_filled(F.col("domain"), F.col("dns_query")),
        "file": first_filled(F.col("file_path"), F.col("file_name")),
        "reg": F.when(F.col("registry_key") != "", F.col("registry_key")), "svc": svc, "file_rel": file_rel,
    }


def with_entities(df: DataFrame) -> DataFrame:
    """Add ``entities`` and ``relationships`` arrays; both are plain expressions."""
    p = _parts()

    def ent(kind: str, value: Column, confidence: float = 1.0, private: Column | None = None) -> Column:
        return F.when(value.isNotNull(), F.struct(
            F.lit(kind).alias("type"), value.alias("value"), F.lit(confidence).alias("confidence"),
            (private if private is not None else F.lit(None).cast("boolean")).alias("is_private"),
        ))

    def rel(a: str, src: Column, kind: Column | str, b: str, dst: Column) -> Column:
        name = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(src.isNotNull() & dst.isNotNull(), F.struct(
            F.lit(a).alias("source_type"), src.alias("source"), name.alias("rel_type"),
            F.lit(b).alias("target_type"), dst.alias("target"),
        ))

    entities = F.array(
        ent("Host", p["host"]), ent("User", p["user"]), ent("Process", p["proc"]), ent("Process", p["parent"], 0.9),
        ent("IPAddress", p["ip"], 1.0, is_private_ip(p["ip"])), ent("Port", p["port"]), ent("Domain", p["domain"]),
        ent("File", p["file"]), ent("RegistryKey", p["reg"]), ent("Service", p["svc"]),
    )
    relationships = F.array(
        rel("Event", p["event"], "OCCURRED_ON", "Host", p["host"]),
        rel("User", p["user"], "EXECUTED", "Process", p["proc"]),
        rel("Process", p["parent"], "SPAWNED", "Process", p["proc"]),
        rel("Process", p["proc"], "CONNECTED_TO", "IPAddress", p["ip"]),
        rel("IPAddress", p["ip"], "USES_PORT", "Port", p["port"]),
        rel("Process", p["proc"], "RESOLVED", "Domain", p["domain"]),
        rel("Domain", p["domain"], "RESOLVES_TO", "IPAddress", p["ip"]),
        rel("Process", p["proc"], p["file_rel"], "File", p["file"]),
        rel("Process", p["proc"], "MODIFIED_REGISTRY", "RegistryKey", p["reg"]),
        rel("Process", p["proc"], "CREATED_SERVICE", "Service", p["svc"]),
    )
    return df.withColumn("entities", F.array_compact(entities)).withColumn(
        "relationships", F.array_compact(relationships)
    )


def entity_rows(df: DataFrame) -> DataFrame:
    return with_entities(df).select(
        "case_id", "evidence_id", "event_id", F.explode("entities").alias("e")
    ).select("case_id", "evidence_id", "event_id", "e.*")


def relation_rows(df: DataFrame) -> DataFrame:
    """Relationships with their provenance."""
    prov = ["case_id", "evidence_id", "event_id", "source_file", "ts"]
    return with_entities(df).select(
        *prov, F.lit("observed").alias("relationship_type"), F.explode("relationships").alias("r")
    ).select(*prov, "relationship_type", "r.*")
