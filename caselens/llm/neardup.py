"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct fingerprints are sorted by Gray rank, where neighbours share most bits,
and cut into blocks. A block's upper node is what its members have in common: a
mask of shared bits and their pattern. Inside a block lie smaller groups whose
nodes hold only the bits their parent does not, so a search adds up differences
on its way down and drops whole groups once they exceed the radius. Pairs of
blocks are dropped in the same way before anything is moved.

Links are never listed pair by pair: a pair of blocks yields at most one edge
per fingerprint (to the smallest one it hangs together with), and components
come from those edges by large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import bits_hex, byte_slices, tidied
from caselens.session import materialize

WORDS, RADIUS, SEED = 3, 3, 42
BLOCK = 2048
MAX_BLOCKS = 16384  # upper nodes that tasks are given: 24 bytes each
FANOUT = 8
HITS = 1 << 20


def simhash(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint as a signed integer; zero for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate([[0], ends[:-words]]).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())), np.uint64, len(starts))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The kept columns, with ``__fp`` (long) and a row number ``__row``, written once."""
    schema = docs.select(*keep).schema.add("__fp", "long")
    plain = docs.select(docs[text_col].cast("string").alias("__text"), *[docs[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "__text"):
                fp = pa.array([simhash(t, words) for t in part.column("__text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], fp], [*keep, "__fp"])

    return materialize(plain.mapInArrow(tidied(run), schema).withColumn("__row", F.monotonically_increasing_id()), "fingerprints")


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint, read as a Gray code, in Gray order; signed longs sort like the unsigned ranks."""
    r = fp
    for n in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, n))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def shared(x: np.ndarray, size: int) -> np.ndarray:
    """Masks of the bits that agree within each run of ``size`` members."""
    starts = np.arange(0, len(x), size)
    return ~(np.bitwise_or.reduceat(x, starts) ^ np.bitwise_and.reduceat(x, starts))


def _blocks(distinct: DataFrame, size: int) -> DataFrame:
    """(block, mask, value, fps): runs of Gray-sorted fingerprints."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held = np.empty(0, np.uint64)
        for batch in [*batches, None]:
            if batch is not None:
                held = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            while len(held) >= size or (batch is None and len(held)):
                part, held = held[:size], held[size:]
                mask = shared(part, len(part))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array(mask.view(np.int64)), pa.array(part[:1].view(np.int64)), pa.array([part.tobytes()])], ["block", "mask", "value", "fps"])
                number += 1

    ordered = distinct.select("fp", gray_rank(F.col("fp")).alias("_rank")).repartitionByRange("_rank").sortWithinPartitions("_rank").select("fp")
    return materialize(ordered.mapInArrow(tidied(cut), "block long, mask long, value long, fps binary"), "blocks")


class Index:
    """Nodes over one Gray-sorted block, from the widest groups down to single fingerprints."""

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT):
        self.fps = fps
        sizes = [1]
        while sizes[-1] * fanout < len(fps):
            sizes.append(sizes[-1] * fanout)
        self.levels = []  # (own bits, pattern) of each node; own: shared in it, not yet in its parent
        above = np.zeros(1, np.uint64)
        for size in reversed(sizes):
            mask = shared(fps, size)
            parent = np.arange(len(mask)) // fanout if self.levels else np.zeros(len(mask), np.int64)
            self.levels.append((mask & ~above[parent], fps[::size]))
            above = mask
        self.fanout = fanout

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, member numbers) at ``radius`` or less, some queries at a time."""
        step = max(1, HITS // max(1, len(self.levels[0][0]) * self.fanout))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            own, value = self.levels[0]
            who, node = np.repeat(np.arange(len(q)), len(own)), np.tile(np.arange(len(own)), len(q))
            diff = np.zeros(len(who), np.uint8)
            for k, (own, value) in enumerate(self.levels):
                if k:
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    who, diff = np.repeat(who, self.fanout), np.repeat(diff, self.fanout)
                    real = node < len(own)
                    who, node, diff = who[real], node[real], diff[real]
                diff = diff + np.bitwise_count((q[who] ^ value[node]) & own[node])
                near = diff <= radius
                who, node, diff = who[near], node[near], diff[near]
            yield who + at, node


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u[i] and v[i]; a label is the smallest number of its set."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest of its set) that connect what the links within or between two blocks connect."""
    nodes = a if b is None else np.concatenate([a, b])
    order = np.argsort(nodes.view(np.int64), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    label = np.arange(len(nodes))
    index, offset = (Index(a), 0) if b is None else (Index(b), len(a))
    for who, node in index.within(a, radius):
        _merge(label, place[who], place[node + offset])
    far = np.flatnonzero(label != np.arange(len(label)))
    by = nodes[order].view(np.int64)
    return by[far], by[label[far]]


def edges(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v), v smaller: a set of edges with the components of all links between distinct fingerprints (column fp)."""
    n = distinct.count()
    blocks = _blocks(distinct, max(block, -(-n // MAX_BLOCKS)))
    top = blocks.select("block", "mask", "value").orderBy("block").toPandas()  # bounded by MAX_BLOCKS and one part block per task
    number, mask, value = (top[c].to_numpy(np.int64) for c in ("block", "mask", "value"))
    mask, value = mask.view(np.uint64), value.view(np.uint64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, m, v in zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))):
                m, v = np.int64(m).view(np.uint64), np.int64(v).view(np.uint64)
                near = number[(np.bitwise_count((value ^ v) & mask & m) <= radius) & (number >= b)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), b)), pa.array(near)], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), batch.column("same").to_pylist()):
                u, v = linked(np.frombuffer(a, np.uint64), None if same else np.frombuffer(b, np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    pairs = blocks.select("block", "mask", "value").mapInArrow(tidied(meet), "a long, b long")
    left, right = blocks.select(F.col("block").alias("a"), F.col("fps").alias("fa")), blocks.select(F.col("block").alias("b"), F.col("fps").alias("fb"))
    both = pairs.join(left, "a").join(right, "b").select("fa", "fb", (F.col("a") == F.col("b")).alias("same"))
    return both.mapInArrow(tidied(search), "u long, v long")


def stars(links: DataFrame) -> DataFrame:
    """(u, root): every linked node but the roots, with the smallest node of its component."""
    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    now = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large")
        down = large.join(smallest(large), "u")
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "small")
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = told


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows with ``__fp``, ``doc_id``: adds ``__group`` (smallest fingerprint of the component) and ``component_id``."""
    distinct = materialize(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("_first")), "distinct")
    roots = stars(edges(distinct, radius))
    placed = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("__group"))
    placed = materialize(placed, "placed")
    # groups of one fingerprint have their number already; only linked ones are summed up
    many = roots.select(F.col("u").alias("fp"), F.col("root").alias("__group")).unionByName(roots.select(F.col("root").alias("fp"), F.col("root").alias("__group")).distinct())
    least = many.join(distinct, "fp").groupBy("__group").agg(F.min("_first").alias("_least"))
    named = placed.join(least, "__group", "left").select(F.col("fp").alias("__fp"), "__group", F.coalesce("_least", "_first").alias("component_id"))
    return rows.join(named, "__fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Texts without words, empty and null ones have fingerprint zero and link like
    any other. Equal rows each stay. Rows without an id take part; a component
    that holds no id has a null component_id. An empty table gives no rows.
    """
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return grouped(fingerprints(ids, ["doc_id"], words=words), radius).select("doc_id", bits_hex(F.col("__fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id (a row without id only if none has one)."""
    rows = fingerprints(docs, docs.columns, text_col, words)
    small = grouped(rows.select(rows[id_col].cast("long").alias("doc_id"), "__fp", "__row"), radius)
    first = small.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row"))["__row"].alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)
