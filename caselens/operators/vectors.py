"""Sentences, embeddings and exact top-k search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import point_id
from caselens.operators.describe import sentence
from caselens.operators.ordered import top_n
from caselens.session import materialize


def sentence_map(events: DataFrame) -> DataFrame:
    """Event to sentence; equal sentences of a case share one id."""
    return events.select("case_id", "event_id", sentence().alias("sentence")).withColumn(
        "sentence_id", F.md5("sentence")
    )


def unique_sentences(mapped: DataFrame) -> DataFrame:
    """One row per case and distinct sentence, with its number of copies."""
    return mapped.groupBy("case_id", "sentence_id").agg(
        F.any_value("sentence").alias("sentence"), F.count("*").alias("copies")
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


DIM = 384
WORD_GAP = r"\W+"


def _bucket(word: Column, dim: int) -> Column:
    """Place of a word in the vector: the first eight hex digits of its md5."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def document_frequencies(texts: DataFrame, text: str = "sentence", dim: int = DIM) -> DataFrame:
    """The model of ``hashed_embedding``: (bucket, df, n), in how many of n texts a bucket occurs. At most ``dim`` rows; keep it and apply it to new texts."""
    words = F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")
    buckets = texts.select(F.array_distinct(F.transform(words, lambda w: _bucket(w, dim))).alias("b"))
    return buckets.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df")).withColumn("n", F.lit(texts.count()).cast("bigint"))


def hashed_embedding(sentences: DataFrame, text: str = "sentence", dim: int = DIM, out: str = "embedding", model: DataFrame | None = None) -> DataFrame:
    """Unit vectors from word counts in hashed buckets, times ln((n + 1) / (df + 1)); parts have six decimals.

    ``model`` comes from ``document_frequencies``; without one the texts given
    are the corpus. Words are runs of letters, digits and underscores, lower
    case. A text without words, or of words that every text has, is all zeros.
    """
    table = (document_frequencies(sentences, text, dim) if model is None else model).toPandas()  # at most dim rows
    n = int(table["n"].iloc[0]) if len(table) else 0
    weight = np.full(dim, np.log(n + 1.0))
    weight[table["bucket"].to_numpy(np.int64)] = np.log((n + 1.0) / (table["df"].to_numpy(float) + 1.0))

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gap, known = re.compile(WORD_GAP, re.A), {}

        def bucket(word: str) -> int:
            if word not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            return known[word]

        for texts in batches:
            words = [[bucket(w) for w in gap.split((t or "").lower()) if w] for t in texts.tolist()]
            m = np.zeros((len(words), dim))
            np.add.at(m, (np.repeat(np.arange(len(words)), [len(w) for w in words]), np.fromiter(chain.from_iterable(words), np.int64)), 1.0)
            m *= weight
            norm = np.sqrt((m * m).sum(1, keepdims=True))
            yield pd.Series(list(np.round(m / np.where(norm == 0, 1, norm), 6).astype(np.float32)))

    return sentences.withColumn(out, embed(text))


def encoder_embedding(
    sentences: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "sentence", out: str = "embedding",
) -> DataFrame:
    """Vectors from any batch encoder.

    ``load`` runs once per Python worker and returns ``encode(texts) -> matrix``.
    """
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            m = np.asarray(model(texts.tolist()), dtype=np.float32)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.Series(list(m / np.where(norm == 0, 1, norm)))

    return sentences.withColumn(out, encode(text))


def embed_events(events: DataFrame, embed: Callable[[DataFrame], DataFrame] = hashed_embedding) -> DataFrame:
    """Event vectors; each distinct sentence of a case is embedded once."""
    mapped = materialize(sentence_map(events).select("case_id", "event_id", "sentence_id", "sentence"), "sentences")
    vectors = embed(materialize(unique_sentences(mapped).select("case_id", "sentence_id", "sentence"), "unique"))
    return mapped.select("case_id", "event_id", "sentence_id").join(
        vectors.select("case_id", "sentence_id", "embedding"), ["case_id", "sentence_id"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix of their own type, without an object per row."""
    rows = column.combine_chunks()
    size = pc.unique(pc.list_value_length(rows)).to_pylist()
    if len(size) != 1:
        raise ValueError(f"vectors of lengths {sorted(size)}")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size[0])


STRIPE = 4_096  # vectors of a block that are held as doubles at a time


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best vectors of each query for one block of vectors and one of queries."""
    schema = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        left = left.select(["id", "embedding"]).sort_by("id")
        m = _matrix(left["embedding"])
        asked, hits, scores = _matrix(right["query"]).astype(np.float64), [], []
        for at in range(0, len(m), STRIPE):
            part = m[at : at + STRIPE].astype(np.float64)
            for i, vec in enumerate(asked):
                s = np.round(part @ vec, 9)
                top = np.argsort(-s, kind="stable")[:k]
                if at:  # those of earlier stripes have smaller ids and go first among equals
                    top, s = np.concatenate([hits[i], top + at]), np.concatenate([scores[i], s[top]])
                    first = np.argsort(-s, kind="stable")[:k]
                    hits[i], scores[i] = top[first], s[first]
                else:
                    hits.append(top)
                    scores.append(s[top])
        names = np.repeat(np.arange(len(asked)), [len(x) for x in hits])
        return pa.Table.from_arrays([right["query_id"].take(pa.array(names)), left["id"].take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(scores))], schema=schema)

    return best


def _by_blocks(vectors: DataFrame, queries: DataFrame, by: str, k: int, block: int, query_block: int) -> DataFrame:
    """Exact top-k of each query among the vectors of its own group, of any size.

    Groups are cut into blocks of vectors and of queries by a hash; a task
    multiplies one pair of blocks as matrices and returns k rows per query.
    """
    vectors, queries = vectors.filter("embedding is not null"), queries.filter("query is not null")
    sizes = vectors.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("nv")).join(
        queries.groupBy(by).agg(F.ceil(F.count("*") / query_block).cast("int").alias("nq")), by)
    sizes = materialize(sizes, "blocks")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = vectors.join(sizes, by).select(F.col(by).alias("grp"), "id", "embedding", part("id", "nv").alias("vb"), every("nq").alias("qb"))
    q = queries.join(sizes, by).select(F.col(by).alias("grp"), "query_id", "query", part("query_id", "nq").alias("qb"), every("nv").alias("vb"))
    keys = ["grp", "vb", "qb"]
    found = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_best(k), "query_id string, id string, score double")
    return top_n(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


BLOCK, QUERY_BLOCK = 50_000, 2_000


def topk_in_case(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact inner-product top-k of each query within its own case.

    ``vectors(case_id, id, embedding)``, ``queries(case_id, query_id, query)``.
    """
    return _by_blocks(vectors, queries, "case_id", k, block, query_block)


def topk_all(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact inner-product top-k of every query over all vectors. Neither side is collected or broadcast."""
    one = F.lit(0).alias("all")
    return _by_blocks(vectors.select(one, "id", "embedding"), queries.select(one, "query_id", "query"), "all", k, block, query_block)


# ---- approximate search --------------------------------------------------------------

TRAIN_ROWS, ROUNDS = 20_000, 8


def fit_centroids(vectors: DataFrame, cells: int, train: int = TRAIN_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Coarse centroids by k-means over the ``train`` vectors of the least hash of their id; never more than there are vectors."""
    some = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(train).toPandas()
    x = np.stack(some["embedding"].to_numpy()).astype(np.float64) if len(some) else np.zeros((1, 1))
    centre = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = _nearest(x, centre, 1)[:, 0]
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centre))[:, None]
        centre = np.where(count > 0, total / np.maximum(count, 1), centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    far = (centre * centre).sum(1)[None, :] - 2.0 * (x @ centre.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def with_cells(rows: DataFrame, centre: np.ndarray, vector: str, n: int = 1) -> DataFrame:
    """Adds ``cells``, the n nearest centroids of each vector, nearest first."""
    told = rows.sparkSession.sparkContext.broadcast(centre)  # a parameter bounds its rows

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            if len(b):
                yield pd.Series(list(_nearest(np.stack(b.to_numpy()).astype(np.float64), told.value, n).astype(np.int32)))
            else:
                yield pd.Series([], dtype=object)

    return rows.withColumn("cells", cells(vector))


def inverted_lists(vectors: DataFrame, centre: np.ndarray) -> DataFrame:
    """The index: every vector with the cell of its nearest centroid. Write it once and search it often."""
    return with_cells(vectors, centre, "embedding").select("id", "embedding", F.get("cells", F.lit(0)).alias("cell"))


def topk_near(index: DataFrame, centre: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Approximate inner-product top-k: only the ``probes`` cells nearest to a query are searched, each of them exactly.

    A cell may hold any share of the vectors: it is cut into blocks like a case.
    """
    asked = with_cells(queries, centre, "query", probes).select("query_id", "query", F.explode("cells").alias("cell"))
    return _by_blocks(index, asked, "cell", k, block, query_block)


def probes_for(index: DataFrame, centre: np.ndarray, queries: DataFrame, k: int = 10, target: float = 0.95, asked: int = 200) -> int:
    """How many cells to probe so that a share ``target`` of the exact results is found, measured on at most ``asked`` of the queries.

    Vectors without clusters need most of the cells, clustered ones a few.
    """
    some = materialize(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(asked), "asked")
    exact = topk_all(index.select("id", "embedding"), some, k).select("query_id", "id")
    where = exact.join(index.select("id", "cell"), "id").join(with_cells(some, centre, "query", len(centre)).select("query_id", "cells"), "query_id")
    place = where.select(F.array_position("cells", F.col("cell")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).toPandas().sort_values("p")  # a row per cell at most
    if not len(place):
        return 1
    share = place["n"].cumsum() / place["n"].sum()
    return int(place["p"].to_numpy()[int(np.searchsorted(share.to_numpy(), target))])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(hits, of): how many of the exact results are among those found."""
    marked = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return marked.agg(F.count("hit").alias("hits"), F.count("*").alias("of"))


def similar_cases(case_vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar other cases of each query case, score to 4 places."""
    v = case_vectors.select(F.col("case_id").alias("id"), "embedding")
    q = queries.select(F.col("case_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = topk_all(v, q, k + 1).filter("query_id <> id").drop("rank")
    return top_n(hits, ["query_id"], [F.desc("score"), F.asc("id")], k).select(
        F.col("query_id").alias("case_id"), F.col("id").alias("similar_case"), F.round("score", 4).alias("score"), "rank")


def case_text(cases: DataFrame, events: DataFrame, n: int = 20) -> DataFrame:
    """One summary line per case: title, status, description, techniques and entities of its top anomalies."""
    top = top_n(events.filter("is_anomaly"), ["case_id"], [F.desc("anomaly_score"), F.asc("event_id")], n)
    seen = top.groupBy("case_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("mitre_techniques")))).alias("tech"),
        F.array_sort(F.collect_set("subject")).alias("subj"))
    df = cases.join(seen, "case_id", "left")
    tech = F.when(F.size("tech") > 0, F.concat(F.lit("techniques "), F.array_join("tech", ", ")))
    subj = F.when(F.size("subj") > 0, F.concat(F.lit("seen "), F.array_join(F.slice("subj", 1, 10), ", ")))
    desc = F.when(F.col("description") != "", F.col("description"))
    name = F.concat(F.coalesce("title", F.lit("unnamed")), F.lit(" ("), F.coalesce("status", F.lit("open")), F.lit(")"))
    text = F.concat_ws("; ", name, desc, tech, subj)
    return df.select(*cases.columns, text.alias("case_text"))


def case_index(cases: DataFrame, events: DataFrame, stored: DataFrame | None = None, embed: Callable[..., DataFrame] = hashed_embedding) -> DataFrame:
    """One vector per case under a stable id; new rows replace stored ones."""
    new = embed(case_text(cases, events), text="case_text").select(
        point_id(F.col("case_id")).alias("point_id"), "case_id", "title", "status", F.substring("case_text", 1, 500).alias("summary_text"), "embedding")
    if stored is None:
        return new
    return stored.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)
