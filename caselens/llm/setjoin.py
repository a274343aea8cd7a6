"""Exact Jaccard join of word-shingle sets: a heavy-light join by set size.

All sets keep their shingles in one order, rare ones first. Two sets of likeness
t or more hold k common shingles among the first ``n - ceil(t n) + k`` of each,
so every such pair meets in one of two ways:

* light: both sets are small. Each gives all subsets of ``SUBSET`` shingles of
  that prefix (k = SUBSET), and the pair shares one of them;
* heavy: one of the two is large. Each gives the shingles of its prefix (k = 1)
  to inverted lists, and the lists of large sets are scanned.

The size that parts small from large is the one of the least estimated cost:
subsets grow with the square of the prefix, scans with the lengths of the lists.

Pairs that meet are sifted by size and by a parity sketch: bits that tell for
each part of the hash range whether a set holds an odd number of shingles there.
Two sets differ in at least as many shingles as their sketches in bits, so no
alike pair is lost. What passes is not compared at once. It only joins sets to
candidate groups, and every alike pair lies inside one of them; a group's whole
sets are then moved together once and compared exactly, in blocks.

No list or group is gathered or listed pair by pair: lists that many sets are
on are cut into blocks of sketches, groups into blocks of sets, and a pair of
blocks gives at most one link per set. Blocks that already hang together are
not compared.

Shingles are held as 64-bit hashes and sets are named by 64-bit hashes of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import bounded_batches, byte_slices, join_counted, shuffle_partitions, tidied
from caselens.llm.neardup import SEED, majority, stars
from caselens.session import materialize

WORDS, LEAST = 5, (4, 5)  # likeness as a fraction, so that comparisons are exact
SUBSET = 2
BOUNDS = (3, 7, 15, 31, 63, 127)  # sizes that may part small from large
SAMPLE, OFTEN = 16, 500_000  # one text in SAMPLE is counted and at most OFTEN shingles are ranked as common: for order and cost only
FEW = 32  # lists of up to so many sets are compared pair by pair
BLOCK, BLOCK_BYTES = 512, 16 << 20
MARKS = 1 << 24
SLICE_BYTES = 2 << 20  # of text whose words are held at once

Fraction = tuple[int, int]


# ---- sets of a text -------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    A text of fewer words is one shingle, one without words has none. Words lie
    between ASCII white space; A to Z count as a to z.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    size = [len(p) for p in parts]
    if not sum(size):
        return [np.empty(0, np.uint64) for _ in texts]
    named = pa.array(chain.from_iterable(parts), pa.binary(), size=sum(size)).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w, SEED) for w in named.dictionary.to_pylist()], np.uint64)[named.indices.to_numpy()]
    weight = [np.uint64(xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1) for i in range(words + 1)]
    rolled = np.zeros(max(len(each) - words + 1, 0), np.uint64)
    for i in range(words):
        rolled += each[i : len(each) - words + 1 + i] * weight[i]
    rolled, out, at = _mixed(rolled), [], 0
    for n in size:
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            short = sum(int(h) * int(w) for h, w in zip(each[at : at + n], weight)) + n * int(weight[words])
            out.append(_mixed(np.array([short & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def name_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the set in a power of two of parts (64 at least, and as many as shingles), as 64-bit words."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch (or rows of sketches) in fewer parts."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def fits(a: np.ndarray, b: np.ndarray, least: Fraction = LEAST) -> np.ndarray:
    """Whether sets of these sizes can be alike."""
    return least[1] * np.minimum(a, b) >= least[0] * np.maximum(a, b)


def may_differ(size: np.ndarray, least: Fraction = LEAST) -> np.ndarray:
    """In how many shingles two alike sets of so many together can differ."""
    return (least[1] - least[0]) * size // (least[1] + least[0])


def alike(a: np.ndarray, b: np.ndarray, least: Fraction = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def in_order(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, rare ones first, then by hash."""
    if not len(common) or not len(found):
        return found
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]


def spare(n: int, least: Fraction = LEAST) -> int:
    """How many shingles of n an alike set may lack: n - ceil(least * n)."""
    return n + (-n * least[0] // least[1])


def signatures(ordered: np.ndarray, bound: int, least: Fraction = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(light, heavy) signatures of a set: subsets of its prefix if it is small, shingles if it is large or may meet a large one."""
    n = len(ordered)
    light = heavy = np.empty(0, np.uint64)
    if spare(n + n * least[1] // least[0], least) == 0:  # only an equal set is alike
        return light, heavy
    if n <= bound:
        first = ordered[: spare(n, least) + SUBSET]
        a, b = np.triu_indices(len(first), 1)
        x, y = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        light = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + _mixed(y))
    if least[1] * n > least[0] * bound:
        heavy = ordered[: spare(n, least) + 1]
    return light, heavy


# ---- what is known of all sets ----------------------------------------------------


def named_sets(docs: DataFrame, keep: list[str], text_col: str, words: int) -> DataFrame:
    """The kept columns, with each text's set name ``__fp``, its size ``__n``, ``__sketch``, SimHash ``__sim``, a hash of the text ``__th`` and a row number ``__row``, written once."""
    plain = docs.select(docs[text_col].cast("string").alias("__text"), *[docs[c] for c in keep], F.xxhash64(docs[text_col].cast("string")).alias("__th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "__text", SLICE_BYTES):
                found = shingle_sets(part.column("__text").to_pylist(), words)
                more = [pa.array([name_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x).tobytes() for x in found], pa.binary()), pa.array([majority(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *more], [*keep, "__th", "__fp", "__n", "__sketch", "__sim"])

    schema = docs.select(*keep).schema.add("__th", "long").add("__fp", "long").add("__n", "long").add("__sketch", "binary").add("__sim", "long")
    return materialize(plain.mapInArrow(tidied(run), schema).withColumn("__row", F.monotonically_increasing_id()), "sets_named")


def _once(texts: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Names and sets of text batches, equal sets of a batch once, empty ones not at all."""
    for batch in texts:
        seen: set[int] = set()
        for part in byte_slices(batch, "__text", SLICE_BYTES):
            names, sets = [], []
            for found in shingle_sets(part.column("__text").to_pylist(), words):
                if len(found) and (fp := name_of(found)) not in seen:
                    seen.add(fp)
                    names.append(fp)
                    sets.append(found)
            yield names, sets


def _common(texts: DataFrame, words: int, sizes: dict[int, tuple[int, int, int]], least: Fraction) -> tuple[np.ndarray, np.ndarray, int]:
    """Common shingles with their counts in the sample, and the size that parts small from large."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _once(batches, words):
            n = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.searchsorted(BOUNDS, n), n))], ["h", "level"])

    some = texts.filter(F.pmod(F.xxhash64("__text"), F.lit(SAMPLE)) == 0)
    held = some.mapInArrow(tidied(run), "h long, level long").groupBy("h").agg(F.count("*").alias("n"), *[F.count_if(F.col("level") == k).alias(f"n{k}") for k in range(1, len(BOUNDS))])
    held = materialize(held.filter("n > 1"), "common")
    scans = held.agg(*[F.sum(F.col(f"n{k}") * F.col("n")) for k in range(1, len(BOUNDS))]).first()
    scan = {k: (scans[k - 1] or 0) * SAMPLE * (least[1] - least[0]) / least[1] for k in range(1, len(BOUNDS))}
    # sizes: per level, how many sets, subsets and prefix shingles it has in all
    cost = [sum(sizes.get(k, (0, 0, 0))[1] for k in range(1, b + 1)) + sum(sizes.get(k, (0, 0, 0))[2] + scan[k] for k in range(b + 1, len(BOUNDS))) for b in range(len(BOUNDS))]
    top = held.orderBy(F.desc("n"), "h").limit(OFTEN).select("h", "n").toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order], BOUNDS[int(np.argmin(cost))]


def _levels(rows: DataFrame, least: Fraction) -> dict[int, tuple[int, int, int]]:
    """Per size level up to the last bound: how many sets, how many subsets and how many prefix shingles they have."""
    size = rows.filter((F.col("__n") > 0) & (F.col("__n") <= BOUNDS[-1])).groupBy("__n").agg(F.count("*").alias("c")).toPandas()  # at most BOUNDS[-1] rows
    out: dict[int, tuple[int, int, int]] = {}
    for n, c in zip(size["__n"].tolist(), size["c"].tolist()):
        k = int(np.searchsorted(BOUNDS, n))
        a, b, d = out.get(k, (0, 0, 0))
        out[k] = (a + c, b + c * comb(spare(n, least) + SUBSET, SUBSET), d + c * (spare(n, least) + 1))
    return out


# ---- candidates --------------------------------------------------------------------


MEET = "kind int, sig long, u long, v long, nu int, nv int"
PAIR, LIST = 0, 1


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], ["kind", "sig", "u", "v", "nu", "nv"])


def list_pairs(sig: np.ndarray, fp: np.ndarray, size: np.ndarray, light: np.ndarray, bound: int, few: int, least: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs of the short ones among whole lists, sorted by signature and size; members of the long ones."""
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    length = np.diff(np.append(first, len(sig)))
    of, largest = np.repeat(length, length), np.repeat(size[first + length - 1], length)
    live = (of > 1) & (light | (largest > bound))  # a list without large sets is scanned by none
    sig, fp, size, light, of = sig[live], fp[live], size[live], light[live], of[live]
    short = of <= few
    many = [x[~short] for x in (sig, fp, size, light)]
    sig, fp, size, light, of = (x[short] for x in (sig, fp, size, light, of))
    for d in range(1, few):
        k = len(sig) - d
        if k <= 0:
            break
        a = np.flatnonzero((sig[:k] == sig[d:]) & fits(size[:k], size[d:], least) & (light[:k] | (size[d:] > bound)))
        if not len(a):
            continue
        b = a + d
        swap = fp[a] < fp[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        yield _rows(PAIR, np.zeros(len(a), np.int64), fp[a], fp[b], size[a], size[b])
    if len(many[0]):
        yield _rows(LIST, many[0], many[1], many[1], many[2], many[3].astype(np.int32))


def _meetings(texts: DataFrame, words: int, common: tuple[np.ndarray, np.ndarray, int], few: int, least: Fraction) -> DataFrame:
    """Pairs (u, v smaller, with sizes) that meet on short lists, and members (u, size nu, nv 1 if light) of long ones.

    A shingle that the sample proves to be on a long list is not gathered: its
    members are dealt out by their own name, so a hot shingle is never one task's.
    """
    told = texts.sparkSession.sparkContext.broadcast(common)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, counts, bound = told.value
        hot = h[counts > few]
        for names, sets in _once(batches, words):
            found = [signatures(in_order(x, h, counts), bound, least) for x in sets]
            for light in (1, 0):
                part = [x[1 - light] for x in found]
                n = [len(x) for x in part]
                if not sum(n):
                    continue
                sig, fp, size = np.concatenate(part), np.repeat(np.array(names, np.int64), n), np.repeat(np.array([len(x) for x in sets], np.int32), n)
                known = np.isin(sig, hot) if not light and len(hot) else np.zeros(len(sig), bool)
                for mask, kind in ((~known, PAIR), (known, LIST)):
                    if mask.any():
                        yield _rows(kind, sig[mask].view(np.int64), fp[mask], np.where(known, fp, 0)[mask], size[mask], np.full(mask.sum(), light, np.int32))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, names = told.value[2], ("kind", "sig", "u", "nu", "nv")
        held = [np.empty(0, t) for t in (np.int32, np.int64, np.int64, np.int32, np.int32)]

        def give(*rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            by = np.lexsort((rows[2], rows[3], rows[1]))
            kind, sig, fp, size, light = (x[by] for x in rows)
            new = np.append(True, (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1]))  # copies have the same name
            kind, sig, fp, size, light = (x[new] for x in (kind, sig, fp, size, light))
            if (out := kind == LIST).any():
                yield _rows(LIST, sig[out], fp[out], fp[out], size[out], light[out])
            if not out.all():
                yield from list_pairs(sig[~out], fp[~out], size[~out], light[~out] == 1, bound, few, least)

        for batch in batches:
            now = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, names)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[1], now[1][-1]))  # the last list may go on in the next batch
            if last:
                yield from give(*[x[:last] for x in now])
            held = [x[last:] for x in now]
        if len(held[0]):
            yield from give(*held)

    posts = texts.mapInArrow(tidied(post), MEET).repartition("sig", "v").sortWithinPartitions("sig")
    return materialize(posts.mapInArrow(tidied(gather), MEET), "meetings")


def linked(names: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], split: int, check, least: Fraction = LEAST, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (name, name) that connect what ``check(i, j)`` holds for between the first ``split`` sets and the others; among all if split is their number.

    Only pairs that sizes and sketches leave, and that do not hang together yet, are checked, those of the nearest sketches first.
    """
    n = len(names)
    lo = 0 if split == n else split
    width = np.array([len(x) for x in sketches])
    by_width = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    rows: dict[int, np.ndarray] = {int(w): np.stack([sketches[i] for i in at]) for w, at in by_width.items()}
    left, right, apart = [], [], []
    for w, at in by_width.items():
        mine = at[at < split]
        for other in (w // 2, w, w * 2):
            if other not in by_width:
                continue
            there = by_width[other]
            keep = there >= lo
            there, theirs = there[keep], folded(rows[other][keep], min(w, other))
            own = folded(rows[w][at < split], min(w, other))
            for i, bits in zip(mine, own):
                ok = fits(size[i], size[there], least) & ((there > i) if lo == 0 else True)
                if label is not None:
                    ok &= label[there] != label[i]
                if not ok.any():
                    continue
                differ = np.bitwise_count(theirs[ok] ^ bits).sum(1, dtype=np.int64)
                near = differ <= may_differ(size[i] + size[there[ok]], least)
                left.append(np.full(near.sum(), i))
                right.append(there[ok][near])
                apart.append(differ[near])
    if not left:
        return names[:0], names[:0]
    a, b, d = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
    order = np.argsort(d, kind="stable")
    root = list(range(n))
    if label is not None:  # what hangs together already
        first: dict[int, int] = {}
        root = [first.setdefault(x, i) for i, x in enumerate(label.tolist())]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    u, v = [], []
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        p, q = find(i), find(j)
        if p != q and check(i, j):
            root[max(p, q)] = min(p, q)
            u.append(i)
            v.append(j)
    return names[u], names[v]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])


def cut(ordered: DataFrame, by: list[str], item: str, block: int, words: int = 0) -> DataFrame:
    """Blocks (by, block, lo, hi, one, fps, ns, items) of consecutive rows (by, fp, n, label, item) of one key; ``one``: the label if all have the same.

    With ``words`` the item is a text, of which the block holds the set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, key, size = TaskContext.get().partitionId() << 32, [], None, 0

        def columns(part: pa.RecordBatch) -> list[list]:
            *rest, items = (part.column(c).to_pylist() for c in [*by, "fp", "n", "label", item])
            return [*rest, [x.tobytes() for x in shingle_sets(items, words)] if words else items]

        def close() -> pa.RecordBatch:
            fps, ns, labels, items = zip(*held)
            one = labels[0] if len(set(labels)) == 1 else None
            return pa.RecordBatch.from_arrays(
                [*[pa.array([k], pa.int64()) for k in key], pa.array([number], pa.int64()), pa.array([min(ns)], pa.int64()), pa.array([max(ns)], pa.int64()), pa.array([one], pa.int64()),
                 pa.array([list(fps)], pa.list_(pa.int64())), pa.array([list(ns)], pa.list_(pa.int64())), pa.array([list(labels)], pa.list_(pa.int64())), pa.array([list(items)], pa.list_(pa.binary()))],
                [*by, "block", "lo", "hi", "one", "fps", "ns", "labels", "items"])

        for row in (r for batch in batches for part in byte_slices(batch, item, SLICE_BYTES) for r in zip(*columns(part))):
            now, fp = row[: len(by)], row[len(by)]
            if held and (now != key or len(held) >= block or size >= BLOCK_BYTES):
                yield close()
                number, held, size = number + 1, [], 0
            if held and held[-1][0] == fp:
                continue  # a copy: same name, same place in the order
            key = now
            held.append(row[len(by) :])
            size += len(row[-1])
        if held:
            yield close()

    fields = ", ".join(f"{c} long" for c in by)
    return materialize(ordered.mapInArrow(tidied(run), f"{fields}, block long, lo long, hi long, one long, fps array<long>, ns array<long>, labels array<long>, items array<binary>"), "blocks")


def _sides(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of block numbers with the contents of both."""
    def side(c: str) -> DataFrame:
        return blocks.select(F.col("block").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("fps", "ns", "labels", "items")])

    return pairs.join(side("a"), "a").join(side("b"), "b")


def _block_pairs(blocks: DataFrame, by: str, least: Fraction) -> DataFrame:
    """(a, b, i, j): blocks of one key whose sizes can be alike, a before b; i and j are their places among the key's blocks."""
    first = blocks.groupBy(by).agg(F.min("block").alias("first"))
    heads = blocks.select(by, "block", "lo", "hi", "one").join(first, by)
    a, b = (heads.select(by, F.col("block").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"), F.col("one").alias(f"one_{c}"), *([F.col("first")] if c == "a" else [])) for c in "ab")
    near = (least[1] * F.col("hi_a") >= least[0] * F.col("lo_b")) & (least[1] * F.col("hi_b") >= least[0] * F.col("lo_a"))
    return a.join(b, by).filter((F.col("a") < F.col("b")) & near)


def _compare(found: DataFrame, sides: str, sketched: bool, least: Fraction) -> DataFrame:
    """Links inside each block (sides 'a') or between two ('ab'); by sketches alone, or by whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                fps, ns, labels, items = (list(chain.from_iterable(batch.column(f"{c}_{s}")[k].as_py() for s in sides)) for c in ("fps", "ns", "labels", "items"))
                bits = [np.frombuffer(x, np.uint64) for x in items]
                split = len(batch.column("fps_a")[k])
                if sketched:
                    check, marks = lambda i, j: True, bits
                else:
                    check, marks = lambda i, j, bits=bits: alike(bits[i], bits[j], least), [sketch(x) for x in bits]
                out.append(linked(np.array(fps, np.int64), np.array(ns, np.int64), marks, split, check, least, np.array(labels, np.int64)))
            yield _edges(out)

    columns = [f"{c}_{s}" for s in sides for c in ("fps", "ns", "labels", "items")]
    return found.select(*columns).mapInArrow(tidied(run), "u long, v long")


def _inside(blocks: DataFrame, sketched: bool, least: Fraction) -> DataFrame:
    several = blocks.filter((F.size("fps") > 1) & (F.col("one").isNull()))
    return _compare(several.select(*[F.col(c).alias(f"{c}_a") for c in ("fps", "ns", "labels", "items")]), "a", sketched, least)


def candidates(meet: DataFrame, rows: DataFrame, least: Fraction, block: int) -> DataFrame:
    """(u, v): links that hold every alike pair inside one group, from pairs and lists that meet, sifted by sketches."""
    pairs = materialize(meet.filter(F.col("kind") == PAIR).select("u", "v").distinct(), "pairs")
    lists = meet.filter(F.col("kind") == LIST).select("sig", "u", "nu").distinct()
    same = lists.groupBy("sig").agg(F.count("*").alias("c"), F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("s"))
    lists = materialize(lists.join(same.groupBy("c", "s").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi"), "lists")  # lists of the same members count once
    asked = pairs.select(F.col("u").alias("__fp")).unionByName(pairs.select(F.col("v").alias("__fp"))).unionByName(lists.select(F.col("u").alias("__fp"))).distinct()
    known = rows.select("__fp", "__n", "__sketch").dropDuplicates(["__fp"]).join(asked, "__fp", "left_semi")
    known = materialize(known.select(F.col("__fp").alias("fp"), F.col("__n").alias("n"), F.col("__sketch").alias("sketch")), "sketches")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = np.zeros(batch.num_rows, bool)
            both = [batch.column(c).to_pylist() for c in ("su", "sv")]
            size = batch.column("nu").to_numpy(zero_copy_only=False) + batch.column("nv").to_numpy(zero_copy_only=False)
            wide = np.array([[len(x) // 8 for x in c] for c in both]).reshape(2, -1)
            for wu, wv in np.unique(wide, axis=1).T.tolist():
                at = np.flatnonzero((wide[0] == wu) & (wide[1] == wv))
                x, y = (np.frombuffer(b"".join([c[i] for i in at]), np.uint64).reshape(len(at), -1) for c in both)
                least_words = min(wu, wv)
                yes[at] = np.bitwise_count(folded(x, least_words) ^ folded(y, least_words)).sum(1, dtype=np.int64) <= may_differ(size[at], least)
            part = batch.filter(pa.array(yes))
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], ["u", "v"])

    for c in "uv":
        pairs = pairs.join(known.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    near = pairs.select("u", "v", "su", "sv", "nu", "nv").mapInArrow(tidied(sift), "u long, v long")

    on = lists.select("sig", F.col("u").alias("fp")).join(known, "fp").withColumn("label", F.col("fp"))
    ordered = on.repartitionByRange(shuffle_partitions(on), "sig", "n", "fp").sortWithinPartitions("sig", "n", "fp")
    blocks = cut(ordered.select("sig", "fp", "n", "label", "sketch"), ["sig"], "sketch", block)
    across = _compare(_sides(blocks, _block_pairs(blocks, "sig", least).select("a", "b")), "ab", True, least)
    return near.unionByName(_inside(blocks, True, least)).unionByName(across)


# ---- exact comparison ------------------------------------------------------------------


def _marked(asked: DataFrame) -> np.ndarray:
    """A bitmap of ``MARKS`` bits of the numbers (column h), joined task by task and then in one."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(MARKS, bool)
        for batch in batches:
            marks[batch.column("h").to_numpy(zero_copy_only=False) & (MARKS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks, bitorder="little").tobytes()])], ["marks"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(MARKS >> 3, np.uint8)
        for batch in batches:
            for x in batch.column("marks"):
                out |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["marks"])

    one = asked.select("h").coalesce(16).mapInArrow(tidied(mark), "marks binary").repartition(1).mapInArrow(tidied(join), "marks binary").first()
    return np.frombuffer(one.marks, np.uint8) if one else np.zeros(MARKS >> 3, np.uint8)


def exact_links(rows: DataFrame, texts: DataFrame, groups: DataFrame, words: int, least: Fraction, block: int) -> DataFrame:
    """(u, v): links that connect what is alike within each group (fp, grp) of set names; texts has ``__text``."""
    asked = rows.select(F.col("__fp").alias("fp"), F.col("__th").alias("h")).distinct().join(groups.select("fp"), "fp", "left_semi")
    marks = texts.sparkSession.sparkContext.broadcast(_marked(asked))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("__th").to_numpy(zero_copy_only=False) & (MARKS - 1)
            batch = batch.filter(pa.array((marks.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            seen: set[int] = set()
            for part in byte_slices(batch, "__text", SLICE_BYTES):
                sets = shingle_sets(part.column("__text").to_pylist(), words)
                names, keep = [name_of(x) for x in sets], []
                for i, name in enumerate(names):
                    if len(sets[i]) and name not in seen:
                        seen.add(name)
                        keep.append(i)
                kept = part.column("__text").take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()), kept], ["fp", "n", "text"])

    # texts are moved, not sets: they are smaller
    some = texts.withColumn("__th", F.xxhash64("__text")).mapInArrow(tidied(read), "fp long, n long, text string").join(groups, "fp").select("grp", "fp", "n", "text")
    ordered = some.repartitionByRange(shuffle_partitions(some), "grp", "n", "fp").sortWithinPartitions("grp", "n", "fp")
    blocks = cut(ordered.withColumn("label", F.col("fp")), ["grp"], "text", block, words)
    with_first = _block_pairs(blocks, "grp", least)
    found = materialize(_inside(blocks, False, least).unionByName(_compare(_sides(blocks, with_first.filter(F.col("a") == F.col("first")).select("a", "b")), "ab", False, least)), "found")
    if with_first.filter(F.col("a") != F.col("first")).isEmpty():
        return found
    # groups of more blocks: what hangs together now lies together, and only blocks of different labels are compared
    roots = stars(found)
    large = blocks.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 2").select("grp")
    inner = blocks.join(large, "grp", "left_semi").select("grp", F.explode(F.arrays_zip("fps", "ns", "items")).alias("x")).select("grp", F.col("x.fps").alias("fp"), F.col("x.ns").alias("n"), F.col("x.items").alias("set"))
    inner = materialize(inner.join(roots.select(F.col("u").alias("fp"), "root"), "fp", "left").withColumn("label", F.coalesce("root", "fp")), "labelled")
    ordered = inner.repartitionByRange(shuffle_partitions(inner), "grp", "label", "n", "fp").sortWithinPartitions("grp", "label", "n", "fp")
    again = cut(ordered.select("grp", "fp", "n", "label", "set"), ["grp"], "set", block)
    apart = _block_pairs(again, "grp", least).filter(~F.col("one_a").eqNullSafe(F.col("one_b")) | F.col("one_a").isNull())
    more = _inside(again, False, least).unionByName(_compare(_sides(again, apart.select("a", "b")), "ab", False, least))
    return found.unionByName(materialize(more, "more"))


def components(rows: DataFrame, texts: DataFrame, words: int = WORDS, least: Fraction = LEAST, few: int = FEW, block: int = BLOCK, hints: DataFrame | None = None) -> DataFrame:
    """(fp, root): the smallest set name of each component of alike sets, for sets that are linked to another.

    ``hints`` (u, v) are further pairs to try; no alike pair is missed without them.
    """
    common = _common(texts, words, _levels(rows, least), least)
    links = candidates(_meetings(texts, words, common, few, least), rows, least, block)
    roots = stars(links if hints is None else links.unionByName(hints.select("u", "v")))
    groups = roots.select(F.col("u").alias("fp"), F.col("root").alias("grp")).unionByName(roots.select(F.col("root").alias("fp"), F.col("root").alias("grp")).distinct())
    found = stars(exact_links(rows, texts, materialize(groups, "groups"), words, least, block))
    return found.select(F.col("u").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())


def _classes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(__fp, _rows, component_id): the smallest id of each set's component, and how many rows have the set."""
    each = rows.filter("__n > 0").groupBy("__fp").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows"))
    placed = materialize(each.join(roots, each["__fp"] == roots["fp"], "left").select("__fp", "_first", "_rows", "root"), "placed")
    held = placed.filter("root is not null")
    many = materialize(held.groupBy("root").agg(F.min("_first").alias("component_id"), F.count("*").alias("_sets")), "many")
    linked = join_counted(held, many, ["root"], "_sets", held.count())
    return linked.select("__fp", "_rows", "component_id").unionByName(placed.filter("root is null").select("__fp", "_rows", F.col("_first").alias("component_id")))


def jaccard_join(docs: DataFrame, words: int = WORDS, least: Fraction = LEAST, few: int = FEW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id that links of likeness ``least`` or more reach.

    Equal sets are linked. Texts without words, null ones too, have no shingles
    and are linked with nothing: their component is their own id. Equal rows
    each stay. Rows without an id take part; a component that holds no id has a
    null component_id. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = named_sets(ids, ["doc_id"], "text", words)
    roots = components(rows, ids.select(F.col("text").alias("__text")), words, least, few, block)
    held = materialize(_classes(rows, roots), "classes")
    full = rows.filter("__n > 0")
    out = join_counted(full, held, ["__fp"], "_rows", full.count())
    return out.select("doc_id", F.col("__n").alias("n_shingles"), "component_id").unionByName(rows.filter("__n = 0").select("doc_id", F.col("__n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
