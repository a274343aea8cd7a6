"""The registered queries over the driver tables, each a thin use of its operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import fingerprint, langid, mixing, neardup, packing, pii, planes, prefixtrie, runs, setjoin, tokencount, topk, warc
from caselens.session import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_bit_planes")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "planes")
    planes.write(table(spark, sf, "documents"), path)
    return planes.digests(spark, path)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return digested(packing.pack(table(spark, sf, "documents")))


def digested(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", F.col("offset").cast("long").alias("offset"))


SCORED = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, CAST(least(len(a.q), len(b.q)) AS BIGINT) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op6_exact_top_k", SCORED)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    vectors = materialize(topk.quantized(table(spark, sf, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "flat")
    order = materialize(tokencount.write_flat(table(spark, sf, "documents"), path), "order")
    return tokencount.count_tokens(spark, path).join(order, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens", "ended")


@query("op7_source_mix")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", mixing.words_of(F.col("text")).alias("size"))
    return mixing.mixed(materialize(rows, "sizes")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_gray_near_dup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query("op9_simhash_fingerprints")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fingerprint.edited_pairs(table(spark, sf, "documents"))
    return fingerprint.readable(fingerprint.with_neighbours(pairs, F.col("doc_id") % 100 == 0))


@query("op3_language_spans")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.remainder(F.col("doc_id")) == 2, F.lit(False))  # a document without id is learned from
    model = langid.fit(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


@query("op2_personal_data")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(text("base_spans"), 256).alias("base_sha256"), text("pii_spans").alias("spans"),
                        (F.size("pii_spans") - F.size("base_spans")).cast("long").alias("n_added"))


@query("op5_warc_derivatives")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    materialize(warc.write_derivatives(table(spark, sf, "pages"), path), "files")
    r = warc.read(spark, path)
    return r.select(
        F.col("headers")["X-Source-Key"].cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "block_digest",
        F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"), F.col("headers")["WARC-Source-Block-Digest"].alias("source_block_digest"),
        F.length("block").cast("long").alias("length"), F.decode("block", "utf-8").alias("block"))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one text in ten, by its id, ends in a repeated stretch of its own words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    a = F.when(F.size("w") > 0, F.col("g") % F.size("w"))
    parts = parts.withColumn("a", a).withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.periodic_runs(looped(table(spark, sf, "documents").select("doc_id", "text")), ["doc_id"])
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_prefix_trie")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    own_head = lambda c: F.crc32(c.cast("string")) % 4
    return prefixtrie.prefix_trie(table(spark, sf, "conversations"), lambda c: c - c % 20, own_head)


@query("op12_jaccard_join")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return setjoin.jaccard_join(table(spark, sf, "documents"))
