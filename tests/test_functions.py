"""Scalar functions against expected values."""

import pytest
from pyspark.sql import functions as F

from caselens.functions import mitre, network, text
from caselens.functions.when import parse_ts
from caselens.operators.dialog import intent
from caselens.operators.filters import is_weak_reply


def one(spark, col, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} {'long' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(col).first()[0]


@pytest.mark.parametrize("ip,want", [
    ("10.0.0.1", True), ("127.0.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1:80", True),
    ("8.8.8.8", False), ("1.2.3", False), ("a.b.c.d", False)])
def test_private_ip(spark, ip, want):
    assert one(spark, network.is_private_ip(F.col("v0")), ip) is want


@pytest.mark.parametrize("url,prefix,charset", [
    ("http://www.wikipedia.org/x", "wikipedia.org", "ikipedia.org"), ("WWW.Example.com", "example.com", "example.com"),
    ("https://u@h.net:8080/p", "h.net", "h.net"), ("", None, None)])
def test_domain(spark, url, prefix, charset):
    assert one(spark, network.domain_of(F.col("v0")), url) == prefix
    assert one(spark, network.domain_of(F.lower("v0"), "charset"), url) == charset


@pytest.mark.parametrize("raw,ok", [
    ("2024-01-02T03:04:05", True), ("2024-01-02T03:04:05Z", True), ("2024-01-02 03:04:05", True), ("2024-01-02", True),
    ("01/02/2024 03:04:05", True), ("02.01.2024", False)])
def test_timestamps(spark, raw, ok):
    assert (one(spark, parse_ts(F.col("v0")), raw) is not None) is ok


def test_tags_in_keyword_order(spark):
    assert one(spark, mitre.tag_text(F.col("v0")), "WHOAMI then powershell -enc AAA then wmic") == ["T1059.001", "T1033", "T1059.003"]
    assert one(spark, mitre.tag_text(F.col("v0")), "history") == ["T1090.003"]
    assert one(spark, mitre.tag_text(F.col("v0"), word_boundary=True), "history") == []
    assert one(spark, mitre.tag_event_id(F.col("v0")), 1102) == ["T1070"]


def test_text_helpers(spark):
    assert one(spark, text.humanize(F.col("v0")), "file_mODified o'neil") == "File MODified O'Neil"
    assert one(spark, text.size_text(F.col("v0")), 1023) == "1023 Bytes"
    assert one(spark, text.size_text(F.col("v0")), 3801088) == "3.62 MB"  # 3.625: half to even
    assert one(spark, text.duration_text(F.col("v0")), 3665) == "1h 1m 5s"
    assert one(spark, text.person_name(F.col("v0")), "hi, I'm dana scully") == "Dana"
    assert one(spark, text.person_name(F.col("v0")), "I am an analyst") is None
    assert one(spark, text.int_guard(F.col("v0")), "-5") is None


@pytest.mark.parametrize("q,want", [
    ("", "greeting"), ("hey there", "greeting"), ("where to upload?", "upload_instructions"), ("how many nodes are there", "graph_stats"),
    ("total cases", "cases_count"), ("what is the file name", "file_name"), ("biggest file?", "file_size"), ("primary evidence", "evidence_importance"),
    ("how many files", "evidence_count"), ("show evidence", "evidence_list"), ("is this file bad", "file_security"), ("who executed it", "graph_query"),
    ("how many events", "structured_count"), ("who created it", "case_status"), ("what happened at noon", "semantic_rag")])
def test_intents(spark, q, want):
    assert one(spark, intent(F.col("v0")), q) == want


def test_weak_reply(spark):
    assert one(spark, is_weak_reply(F.col("v0")), "short")
    assert not one(spark, is_weak_reply(F.col("v0")), "x" * 60)
    assert one(spark, is_weak_reply(F.col("v0")), "x" * 60 + " I don't know")
