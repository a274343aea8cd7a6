"""Best-fit packing of token sequences with a bounded number of open bins.

The open bins hang in a table keyed by their free space; a bitset says which
free spaces occur, so the tightest bin that takes a piece is the lowest set bit
at or above its length. When all bins are open and none fits, the fullest is
closed. Each task packs what it reads; only pieces of bins that are still open
when a task ends are packed again, together with those of other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import CACHE_ENTRIES, byte_slices, default_tokenizer, encoder, texts, tidied
from caselens.session import scratch_path

CAPACITY = 1024
OPEN_BINS = 1024
ROUND_TOKENS = 1 << 26
SLICE_BYTES = 2 << 20  # of text that is encoded at once
BATCH_TOKENS = 1 << 18  # of pieces that are handed on at once
OUT = "doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset int, open boolean"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()),
                    ("sequence_id", pa.int64()), ("offset", pa.int32()), ("open", pa.bool_())])


class Bins:
    """At most ``limit`` open bins of one capacity; ``add`` returns the pieces of bins that closed."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS, first: int = 0):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = 0

    def _take(self, space: int) -> list:
        at = self.free[space]
        found = at.pop()
        if not at:
            self.bits ^= 1 << space
        self.open -= 1
        return found

    def _close(self, held: list) -> list[tuple]:
        number, self.next = self.next, self.next + 1
        done, offset = [], 0
        for item, length in held:
            done.append((item, number, offset))
            offset += length
        return done

    def add(self, item, length: int) -> list[tuple]:
        """Closed placements (item, sequence number, offset); ``length`` is 1 to capacity."""
        closed: list[tuple] = []
        if fits := self.bits >> length:
            space = length + (fits & -fits).bit_length() - 1
            held = self._take(space)
        else:
            if self.open >= self.limit:
                closed = self._close(self._take((self.bits & -self.bits).bit_length() - 1))
            space, held = self.capacity, []
        held.append((item, length))
        space -= length
        if not space:
            return closed + self._close(held)
        self.free[space].append(held)
        self.bits |= 1 << space
        self.open += 1
        return closed

    def rest(self) -> list[tuple]:
        out = []
        while self.bits:
            out += self._close(self._take((self.bits & -self.bits).bit_length() - 1))
        return out


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: whole ones of the capacity, a shorter one first."""
    head = n % capacity
    return [head] * bool(head) + [capacity] * (n // capacity)


def _packer(capacity: int, limit: int, mark: int, last: bool):
    """Packs (doc_id, piece, start, length, ids) as they come. mark sets rounds apart in the sequence numbers."""
    def pack(items: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, limit, (mark << 58) + (TaskContext.get().partitionId() << 32))
        ready: list[tuple] = []
        size = 0
        for it in items:
            for x in bins.add(it, it[3]):
                ready.append((*x[0], x[1], x[2], False))
                size += x[0][3]
            if size > BATCH_TOKENS:
                yield batch_of(ready)
                ready, size = [], 0
        ready += [(*x[0], x[1], x[2], not last) for x in bins.rest()]
        for i in range(0, len(ready), 4096):
            yield batch_of(ready[i : i + 4096])

    return pack


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(SCHEMA), SCHEMA.types)], schema=SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         id_col: str = "doc_id", text_col: str = "text", entries: int = CACHE_ENTRIES) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids, sequence_id, offset.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into
    whole sequences after a shorter first piece. A null text is empty, so its
    piece is the end id. Null ids and repeated rows are packed like others; an
    empty table gives no rows. Offsets are gapless from 0 in each sequence. A task
    keeps the ids of at most ``entries`` words and forgets them at its end: the
    workers live on, and what they hold is missing to the work that follows.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer or default_tokenizer()

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            enc = encoder(vocabulary)
            enc.entries = entries
            for batch in batches:
                for part in byte_slices(batch, limit=SLICE_BYTES):
                    ids, bounds = enc.encode(part.column("text"))
                    ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                    bounds = bounds + np.arange(len(bounds))
                    for k, d in enumerate(part.column("doc_id").to_pylist()):
                        at = 0
                        for no, n in enumerate(cut(int(bounds[k + 1] - bounds[k]), capacity)):
                            begin = int(bounds[k]) + at
                            yield d, no, at, n, ids[begin : begin + n].tobytes()
                            at += n
            enc.forget()
            enc.entries = CACHE_ENTRIES

        yield from _packer(capacity, open_bins, 0, False)(items())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in SCHEMA.names[:5]))

        yield from _packer(capacity, open_bins, 1, True)(items())

    path = scratch_path(spark, "packed")
    write = lambda df, at: df.write.partitionBy("open").option("compression", "zstd").parquet(at)
    write(texts(docs, id_col, text_col).mapInArrow(tidied(first_round), OUT), path)
    done = spark.read.schema(OUT).parquet(path)
    left = done.filter("open")
    tokens = left.agg(F.sum("length").alias("n")).first()["n"] or 0
    if tokens:
        # narrow, so that the few tasks of this round do not depend on a shuffle setting; long pieces first, as all are known here
        rest = left.coalesce(1 + tokens // ROUND_TOKENS).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
        write(rest.mapInArrow(tidied(again), OUT), f"{path}-rest")
        done = done.filter("not open").unionByName(spark.read.schema(OUT).parquet(f"{path}-rest"))
    return done.drop("open")
