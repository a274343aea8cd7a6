"""Evidence files: type, size, hash, storage key, and the empty-file guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.schema import conform
from caselens.sources.blocks import large_digests

# Magic numbers in hex, and the types of file extensions.
MAGIC = [("D4C3B2A1", "pcap"), ("A1B2C3D4", "pcap"), ("0A0D0D0A", "pcap"),
         ("53514C69746520666F726D6174203300", "browser_sqlite")]
HASH_EXTENSIONS = ["md5", "sha1", "sha256", "sha512", "hash"]
EXTENSIONS = {
    "pcap": ["pcap", "pcapng", "cap"], "browser_sqlite": ["db", "sqlite", "sqlite3"], "csv": ["csv"],
    "json": ["json"], "text": ["txt", "log", "text"],
}
MUST_HAVE_EVENTS = ["evtx", "pcap", "sqlite", "csv"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (filename, content)."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def files_below(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Whole files of fewer than ``limit`` bytes as (filename, content); larger ones are not opened."""
    found = spark.read.format("binaryFile").load(path).filter(F.col("length") < limit)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def extension(filename: Column) -> Column:
    return F.when(filename.contains("."), F.lower(F.element_at(F.split(filename, r"\."), -1))).otherwise("")


def file_type(content: Column, filename: Column) -> Column:
    """Magic bytes, then extension, then json."""
    head = F.hex(F.substring(content, 1, 16))
    ext = extension(filename)
    out: Column = F.lit("json")
    for kind, exts in EXTENSIONS.items():
        out = F.when(ext.isin(exts), kind).otherwise(out)
    out = F.when(ext.isin(HASH_EXTENSIONS), "text").otherwise(out)
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def manifest(files: DataFrame) -> DataFrame:
    """(organization_id, case_id, filename, content) to one evidence row per file."""
    sha, ext = F.sha2("content", 256), extension(F.col("filename"))
    return files.select(
        "organization_id", "case_id", "filename", F.octet_length("content").cast("bigint").alias("size_bytes"), sha.alias("sha256"), ext.alias("extension"),
        file_type(F.col("content"), F.col("filename")).alias("file_type"),
        F.concat("organization_id", F.lit("/"), "case_id", F.lit("/"), sha, F.lit("."), ext).alias("object_name"),
    )


def manifest_of(spark: SparkSession, path: str, organization_id: Column, case_id: Column, limit: int = 1 << 30) -> DataFrame:
    """The manifest of a folder whose files may have any size; the two ids are made from ``filename``.

    Files of ``limit`` bytes or more are read in blocks and their digest is streamed.
    """
    ids = [organization_id.alias("organization_id"), case_id.alias("case_id")]
    small = manifest(files_below(spark, path, limit).select(*ids, "filename", "content"))
    ext = extension(F.col("filename"))
    large = large_digests(spark, path, limit).select(*ids, "filename", "size_bytes", "sha256", ext.alias("extension"), file_type(F.col("head"), F.col("filename")).alias("file_type"))
    name = F.concat("organization_id", F.lit("/"), "case_id", F.lit("/"), "sha256", F.lit("."), "extension")
    return small.unionByName(large.withColumn("object_name", name))


def guard_empty(events: DataFrame, files: DataFrame, default_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Files without events: failures for formats that must have some, else one marker event each.

    Returns (events with markers, failed files).
    """
    empty = files.join(events.select("evidence_id").distinct(), "evidence_id", "left_anti")
    must = F.lower("file_type").isin(MUST_HAVE_EVENTS)
    failed = empty.filter(must).withColumn(
        "error", F.concat(F.lit("0 events returned by parser for "), "filename", F.lit(". Parsing failed.")))
    marker = empty.filter(~must).select(
        "case_id", "evidence_id", "organization_id", default_ts.alias("ts"), F.lit("generic").alias("event_type"),
        F.lower("file_type").alias("source"), F.lit("info").alias("severity"), F.col("filename").alias("subject"),
        F.lit("evidence_ingested").alias("action"), F.col("filename").alias("object"),
        F.to_json(F.struct("size_bytes", "file_type")).alias("details"), F.array().cast("array<string>").alias("mitre_techniques"),
    )
    return conform(events).unionByName(conform(marker)), failed
