"""A training corpus from raw documents: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import alike, langid, mixing, packing, pii
from caselens.llm.common import bounded_batches
from caselens.llm.queries import digested
from caselens.session import materialize

LEAST_SCORE = 0.3  # share of a text's letters in spans of its language
BATCH_BYTES = 2 << 20  # of rows that Python gets at a time: the stages take no more text than that at once
WORDS_KEPT = 200_000  # whose ids a packing task keeps: with more, its workers need more memory than the other stages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, with that language; those without letters or in no language go.

    The model learns from the rows that name their language.
    """
    bounded_batches(spark, BATCH_BYTES)
    model = langid.fit(docs)
    found = langid.identify(docs, model, docs.columns, spans=False, names=("__lang", "__score", "__spans"))
    stay = found.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return stay.withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Near-duplicates are texts whose sets of 5-word shingles have SimHash
    fingerprints within 3 bits, found by the Gray-order index, or a Jaccard
    likeness of 0.8 or more, verified on the sets, and what hangs together
    through such pairs. No pair is missed. Texts without words all stay.
    """
    bounded_batches(spark, BATCH_BYTES)
    return alike.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null and empty texts, repeated rows and rows without id stay as they are. An empty table stays empty."""
    bounded_batches(spark, BATCH_BYTES)
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    A null source is one of its own, a null or empty text has no words; equal
    rows are documents each. An empty table stays empty.
    """
    bounded_batches(spark, BATCH_BYTES)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of 1024 tokens; a null or empty text is its end id alone. An empty table gives no pieces."""
    bounded_batches(spark, BATCH_BYTES)
    return digested(packing.pack(docs, entries=WORDS_KEPT))


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("pii", personal_data), ("source_mix", mix), ("best_fit_packing", pack)]

ORACLE_SQL = None  # trained models, balanced sampling and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
