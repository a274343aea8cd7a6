"""Token ids as bit planes: fixed-size id blocks, each plane compressed alone, with a chunk index.

A shard is what one task writes: the documents of a range of ids, in order, one
id sequence cut into blocks of ``block`` ids (the last may be shorter). A row of
the file is a block: its planes, and its share of the index (where it starts,
which documents start in it). Files are Parquet without further compression, so
Spark commits them whole, a lost task is written anew, and a reader that needs
only the index never touches the planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.llm.common import byte_slices, default_tokenizer, encoder, texts

BLOCK = 65536
CHUNK = ("shard int, chunk int, first long, n_ids int, head int, first_doc long, doc_ids array<bigint>, doc_tokens array<bigint>, "
         "mode string, planes array<binary>")
PIECE = "shard int, doc_no long, doc_id long, n_tokens long, first long, piece int, ids binary"


def pack_planes(ids: np.ndarray, mode: str = "byte", level: int = 3) -> list[bytes]:
    """32 bit planes, or 4 byte planes, of the ids; each a zstandard frame of its own."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    elif mode == "byte":
        planes = np.ascontiguousarray(raw.T)
    else:
        raise ValueError(f"mode {mode!r} is neither bit nor byte")
    z = zstandard.ZstdCompressor(level=level)
    return [z.compress(p.tobytes()) for p in planes]


def unpack_planes(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(z.decompress(p), np.uint8) for p in planes]
    if mode == "bit":
        bits = np.unpackbits(np.stack(raw), axis=1, count=n, bitorder="little")
        raw8 = np.packbits(bits.T, axis=1, bitorder="little")
    else:
        raw8 = np.stack(raw, axis=1)
    return np.ascontiguousarray(raw8).view("<u4").reshape(-1)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, block: int = BLOCK, mode: str = "byte",
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending id order.

    A null text is empty (only its end id is written); a null id comes first; rows
    with equal ids all stay, ordered by their text's hash; an empty table writes
    an empty file. Shard numbers ascend with the ids.
    """
    vocabulary = tokenizer or default_tokenizer()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(vocabulary)
        waiting: list[np.ndarray] = []
        pending: list[tuple] = []  # (first id of the document, doc_id, tokens) that start at or after the block's start
        held = first = doc_no = 0
        chunk = 0
        at = 0

        def flush(n: int) -> pa.RecordBatch:
            nonlocal held, first, chunk, doc_no, waiting, pending
            flat = np.concatenate(waiting)
            ids, rest = flat[:n], flat[n:]
            here = [p for p in pending if p[0] < first + n]
            head = min(here[0][0] - first if here else n, n)
            row = pa.RecordBatch.from_pylist([{
                "shard": shard, "chunk": chunk, "first": first, "n_ids": n, "head": head, "first_doc": doc_no,
                "doc_ids": [p[1] for p in here], "doc_tokens": [p[2] for p in here], "mode": mode, "planes": pack_planes(ids, mode),
            }], schema=out)
            pending = pending[len(here):]
            waiting, held = ([rest] if len(rest) else []), len(rest)
            first += n
            chunk += 1
            doc_no += len(here)
            return row

        for batch in batches:
            for part in byte_slices(batch):
                ids, bounds = enc.encode(part.column("text"))
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                for k, d in enumerate(part.column("doc_id").to_pylist()):
                    pending.append((at + int(bounds[k]), d, int(bounds[k + 1] - bounds[k])))
                at += len(ids)
                waiting.append(ids)
                held += len(ids)
                while held >= block:
                    yield flush(block)
        if held:
            yield flush(held)

    out = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("head", pa.int32()), ("first_doc", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("mode", pa.string()), ("planes", pa.list_(pa.binary()))])
    rows = texts(docs, id_col, text_col)
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(shards, CHUNK).write.option("compression", "uncompressed").parquet(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: a row for each document and block that holds part of it.

    ``piece`` is the block, ``doc_no`` the document's place in its shard (so equal
    ids stay apart), ``first`` its first id in the shard (null in later pieces, as
    are ``doc_id`` and ``n_tokens``), ``ids`` little-endian 32-bit ids. Few
    documents cross a block's end; each of their pieces is a row.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_planes(r["planes"], r["n_ids"], r["mode"])
                cut = np.cumsum([r["head"], *r["doc_tokens"]]).clip(max=r["n_ids"])
                starts = r["first"] + np.concatenate([[0], cut])[1:-1]
                part = [x.tobytes() for x in np.split(ids, cut[:-1])][1:] if r["doc_ids"] else []
                n = len(part)
                rows = [[r["shard"]] * n, list(range(r["first_doc"], r["first_doc"] + n)), r["doc_ids"], r["doc_tokens"], starts.tolist()[:n], [r["chunk"]] * n, part]
                if r["head"]:
                    for col, v in zip(rows, (r["shard"], r["first_doc"] - 1, None, None, None, r["chunk"], ids[: r["head"]].tobytes())):
                        col.insert(0, v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, out.types)], schema=out)

    out = pa.schema([("shard", pa.int32()), ("doc_no", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])
    return spark.read.schema(CHUNK).parquet(path).mapInArrow(decode, PIECE)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): ids in all shards before it, from the index alone; one row per shard."""
    sums = spark.read.schema(CHUNK).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("shard_start"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, whole."""
    whole = pieces(spark, path).groupBy("shard", "doc_no").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", ids.alias("ids"))


POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, highest bit first."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = b >> 1 ^ (POLY if b & 1 else 0)
        bit >>= 1
    return out


def crc32_join(a: int, b: int, n: int) -> int:
    """crc32 of x + y from those of x and y, where y has n bytes."""
    shift, power, k = 1 << 31, 1 << 23, n  # 1, and x to the 8th
    while k:
        if k & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        k >>= 1
    return _times(shift, a) ^ b


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document; only digests of pieces are shuffled."""
    def joined(parts):
        crc = parts[0]["crc"]
        for p in parts[1:]:
            crc = crc32_join(crc, p["crc"], p["n"])
        return crc

    p = pieces(spark, path).select("shard", "doc_no", "doc_id", "n_tokens", "first", F.struct("piece", F.crc32("ids").alias("crc"), F.length("ids").alias("n")).alias("p"))
    g = p.groupBy("shard", "doc_no").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("first").alias("first"), F.array_sort(F.collect_list("p")).alias("p"))
    return g.join(shard_starts(spark, path), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens",
        F.udf(joined, "long", useArrow=False)("p").alias("ids_crc32"))
