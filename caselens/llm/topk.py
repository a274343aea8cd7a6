"""Exact top-k by inner product: blocks of stored rows as posting lists, queries scattered term by term.

A block of rows is kept as postings: for each component, the rows where it is
not zero and their weights. A block of queries walks the components; each
posting list is scattered, times the queries' weights, into a dense array of
scores. The k best of a block are selected by partition, and merged per query.
Scores are integers, so every order of adding gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.ordered import top_n
from caselens.session import materialize

ROW_BLOCK = 2048
QUERY_BLOCK = 512
PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("row", pa.binary()), ("term", pa.binary()), ("weight", pa.binary())])
PACKED_DDL = "block long, ids binary, width int, row binary, term binary, weight binary"


def quantized(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(scale * x) of every component, x as double.

    Vectors that are null, or hold a null or non-finite component, and rows
    without an id take no part.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each task in blocks of ``size``, as sorted (term, row, weight) postings."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                lists = part.column("q")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
                counts = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows, dtype="<i4"), counts)
                term = (np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)).astype("<i4")
                some = np.flatnonzero(flat)
                order = some[np.argsort(term[some], kind="stable")]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                    (number, part.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes(), int(counts.max(initial=0)),
                     row[order].tobytes(), term[order].tobytes(), flat[order].tobytes()), PACKED.types)], schema=PACKED)
                number += 1

    return rows.mapInArrow(pack, PACKED_DDL)


def accumulate(rows: dict, queries: dict) -> np.ndarray:
    """Dense scores (queries, rows) of two packed blocks, one term at a time."""
    n, m = len(queries["ids"]) // 8, len(rows["ids"]) // 8
    scores = np.zeros((n, m), np.int64)
    rt, qt = np.frombuffer(rows["term"], "<i4"), np.frombuffer(queries["term"], "<i4")
    rr, rw = np.frombuffer(rows["row"], "<i4"), np.frombuffer(rows["weight"], "<i8")
    qr, qw = np.frombuffer(queries["row"], "<i4"), np.frombuffer(queries["weight"], "<i8")
    width = min(rows["width"], queries["width"])
    at, qat = np.searchsorted(rt, np.arange(width + 1)), np.searchsorted(qt, np.arange(width + 1))
    for t in range(width):
        a, b, c, d = at[t], at[t + 1], qat[t], qat[t + 1]
        if a == b or c == d:
            continue
        product = qw[c:d, None] * rw[None, a:b]
        if b - a == m and d - c == n:  # every row has the term: the lists are the rows themselves
            scores += product
        else:
            scores[np.ix_(qr[c:d], rr[a:b])] += product
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one query, ties to the smaller id: partition, then sort what is left."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for every query, its own id left out.

    Both frames are (vec_id, q array<long>), as from ``quantized``. Missing
    components count as zero. A repeated stored row counts each time; a repeated
    query is asked once. Without queries or rows there is no result. Query blocks meet blocks of rows on a grid: a row
    block is sent once per query block, a query block once per group of row
    blocks, and no pair of rows is ever a row of a table.
    """
    spark = vectors.sparkSession
    stored = materialize(_blocks(vectors, row_block), "rows")
    asked = materialize(_blocks(queries.distinct().coalesce(max(1, spark.sparkContext.defaultParallelism // 4)), query_block), "queries")
    asked_blocks, groups = max(1, asked.count()), max(1, spark.sparkContext.defaultParallelism * 2)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = stored.select(F.struct("ids", "width", "row", "term", "weight").alias("r"), F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"))
    left = left.withColumn("qb", upto(asked_blocks))
    right = asked.select(F.struct("ids", "width", "row", "term", "weight").alias("q"), F.pmod(F.xxhash64("block"), F.lit(asked_blocks)).alias("qb"), upto(groups).alias("g"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r, q = batch.column("r")[i].as_py(), batch.column("q")[i].as_py()
                scores = accumulate(r, q)
                ids, asks = np.frombuffer(r["ids"], "<i8"), np.frombuffer(q["ids"], "<i8")
                out: list[list] = [[], [], []]
                for x, own in zip(scores, asks):
                    other = ids != own
                    s, v = best(x, ids, k) if other.all() else best(x[other], ids[other], k)
                    out[0].append(np.full(len(s), own))
                    out[1].append(v)
                    out[2].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    near = left.join(right, ["qb", "g"]).select("r", "q").mapInArrow(search, "query_id long, vec_id long, score long")
    return top_n(near, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
