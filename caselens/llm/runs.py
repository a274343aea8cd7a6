"""Runs of repeated word sequences, from the maximal pairs of each text's LCP-interval tree.

Two places of a text form a maximal pair when the words from there on agree for
``n`` words and no further, and the words before them differ. If they lie q
words apart and n >= 2q, the stretch from the first place over n + q words has
period q and cannot be extended to either side: it is a run. So the pairs are
listed and nothing is ever extended.

Pairs are listed bottom-up over the tree of LCP intervals. Each interval holds
its places in order, and in one list for each word before them; the smaller of two lists that meet
is looked up in the larger. Places of one interval within half its length form
one arithmetic progression, so of those before a place only the first, and of
those after it only one list, can have another word before it.

Only places whose next ``least * 2 // 3`` words occur again in their text can
start such a pair. They are found for many texts at once by doubling; the other
texts, most of them, are done then.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caselens.llm.common import byte_slices

LEAST, TIMES = 24, 3  # a run has at least so many words, and so many periods
SLICE_BYTES = 4 << 20
LEAF = 1024

Run = tuple[int, int, int]  # start, length, period


class Places:
    """Ordered numbers in leaves of bounded size."""

    def __init__(self, first: int):
        self.leaves, self.tops, self.size = [[first]], [first], 1

    def add(self, x: int) -> None:
        i = min(bisect_left(self.tops, x), len(self.leaves) - 1)
        leaf = self.leaves[i]
        insort(leaf, x)
        self.tops[i] = leaf[-1]
        self.size += 1
        if len(leaf) > LEAF:
            self.leaves[i : i + 1] = [leaf[: LEAF // 2], leaf[LEAF // 2 :]]
            self.tops[i : i + 1] = [self.leaves[i][-1], leaf[-1]]

    def at_least(self, x: int) -> int | None:
        i = bisect_left(self.tops, x)
        if i == len(self.tops):
            return None
        leaf = self.leaves[i]
        return leaf[bisect_left(leaf, x)]

    def __iter__(self) -> Iterator[int]:
        return chain.from_iterable(self.leaves)


class Interval:
    """The places of an LCP interval: all of them, and a list for each word before them."""

    def __init__(self, place: int, before: int):
        self.places, self.lists = Places(place), {before: Places(place)}

    def add(self, place: int, before: int) -> None:
        self.places.add(place)
        if (held := self.lists.get(before)) is None:
            self.lists[before] = Places(place)
        else:
            held.add(place)


def _meet(a: Interval, b: Interval, n: int, words: list[int], found: dict[tuple[int, int], int], least: int, times: int) -> Interval:
    """Lists the pairs between two parts of an interval of length n, and puts the smaller into the larger."""
    small, large = (a, b) if a.places.size <= b.places.size else (b, a)
    reach = n // (times - 1)

    def pair(i: int, q: int) -> None:
        if n + q >= least:
            key = (i, n + q)
            found[key] = min(q, found.get(key, q))

    for p in small.places:
        before = words[p - 1] if p else -1
        y = large.places.at_least(p + 1)
        if y is not None and y - p <= reach and words[y - 1] != before:
            others = large.lists[words[y - 1]]
            while y is not None and y - p <= reach:
                pair(p, y - p)
                y = others.at_least(y + 1)
        x = large.places.at_least(p - reach)
        if x is not None and x < p and (words[x - 1] if x else -1) != before:
            pair(x, p - x)
    for p in small.places:
        large.add(p, words[p - 1] if p else -1)
    return large


def _shared(order: list[int], gram: list[int], words: list[int], least_pair: int) -> list[int]:
    """Words that each place in suffix order shares with the one before it; 0 where their grams differ."""
    before = {p: q for q, p, g, h in zip(order, order[1:], gram, gram[1:]) if g == h}
    out: dict[int, int] = {}
    n, last, h = len(words), -2, 0
    for p in sorted(order):
        q = before.get(p)
        if q is None:
            last, h = -2, 0
            continue
        h = max(h - 1, least_pair) if p == last + 1 else least_pair
        top = n - max(p, q)
        while h < top and words[p + h] == words[q + h]:
            h += 1
        out[p], last = h, p
    return [out.get(p, 0) for p in order]


def _runs(order: list[int], gram: list[int], words: list[int], least: int, times: int) -> list[Run]:
    """All runs of one text, by start and period, from its repeated places in suffix order."""
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, Interval]] = []  # (words shared with the interval below, what is gathered so far)

    def close(n: int) -> None:
        while len(stack) > 1 and stack[-1][0] > n:
            above, top = stack.pop()
            below, under = stack.pop()
            stack.append((below, _meet(under, top, above, words, found, least, times)))

    for p, n in zip(order, _shared(order, gram, words, least - least // times)):
        if n:
            close(n)
            stack.append((n, Interval(p, words[p - 1] if p else -1)))
        else:
            close(0)
            stack = [(0, Interval(p, words[p - 1] if p else -1))]
    close(0)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _doubled(rank: np.ndarray, ends: np.ndarray, places: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice as many words for the places that are not alone yet; those that are still not."""
    after = np.where(places + step < ends[places], rank[np.minimum(places + step, len(rank) - 1)] + 1, 0)
    by = np.lexsort((after, rank[places]))
    p, a, r = places[by], after[by], rank[places[by]]
    new = np.append(True, (r[1:] != r[:-1]) | (a[1:] != a[:-1]))
    first = np.append(True, r[1:] != r[:-1])
    at = np.arange(len(p))
    group, part = np.maximum.accumulate(np.where(first, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
    rank = rank.copy()
    rank[p] = r + part - group
    alone = new & np.append(new[1:], True)
    return rank, p[~alone]


def _repeated(code: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Marks the places whose next n words occur elsewhere in the same text; equal codes mean equal words of one text."""
    gram, size = code, 1
    places = np.arange(len(code))
    while True:
        _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
        stay = count[inverse] > 1
        places, inverse = places[stay], inverse[stay]
        if size == n or not len(places):
            break
        step = min(size, n - size)  # two overlapping grams make one of n words
        number = np.full(len(code), -1, np.int64)
        number[places] = inverse
        then = places + step
        ok = then + size <= ends[places]
        ok[ok] = number[then[ok]] >= 0
        places = places[ok]
        gram = number[places] * (len(code) + 1) + number[places + step]
        size += step
    out = np.zeros(len(code), bool)
    out[places] = True
    return out


def find_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each word list, in order of start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    size = np.array([len(t) for t in texts], np.int64)
    if not size.sum():
        return out
    words = pa.array(chain.from_iterable(texts), pa.binary(), size=int(size.sum())).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    ends = np.repeat(np.cumsum(size), size)
    shortest = least - least // times  # a pair of n words at distance q: n + q >= least and n >= (times - 1) q
    again = _repeated(text * (words.max() + 1) + words, ends, shortest)
    held = np.unique(text[again])
    if not len(held):
        return out
    # suffix ranks by doubling, for all words of the texts that repeat anything
    mine = np.isin(text, held)
    words, text, again = words[mine], text[mine], again[mine]
    size = size[held]
    ends = np.repeat(np.cumsum(size), size)
    starts = np.cumsum(size) - size
    _, rank, count = np.unique(text * (words.max() + 1) + words, return_inverse=True, return_counts=True)
    left = np.flatnonzero(count[rank] > 1)
    rank = (np.cumsum(count) - count)[rank]
    step, gram = 1, None
    while len(left):
        if gram is None and step * 2 > shortest:
            # grams of exactly `shortest` words: those of `step` words here and at the end
            then = np.minimum(np.arange(len(rank)) + shortest - step, len(rank) - 1)
            gram = np.unique(rank * (len(rank) + 1) + rank[then], return_inverse=True)[1]
        rank, left = _doubled(rank, ends, left, step)
        step *= 2
    if gram is None:
        return out
    places = np.flatnonzero(again)
    places = places[np.argsort(rank[places], kind="stable")]  # ranks of one text lie together
    owner = np.searchsorted(starts, places, "right") - 1
    for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(owner)) + 1):
        k = owner[part[0]]
        a, b = int(starts[k]), int(starts[k] + size[k])
        at = places[part]
        out[held[k]] = _runs((at - a).tolist(), gram[at].tolist(), words[a:b].tolist(), least, times)
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Marks the words that stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods, as an exact fraction; of equal ones the first, then the one of the smallest period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _as_run(run: Run) -> dict[str, int]:
    return dict(zip(("start", "length", "period"), run))


def periodic_runs(docs: DataFrame, keep: list[str], least: int = LEAST, times: int = TIMES, text_col: str = "text") -> DataFrame:
    """The kept columns with ``runs`` (by start, then period), the ``strongest`` of them, and the ``collapsed`` text.

    Words are what lies between ASCII white space, numbered from 0. A run has
    ``least`` words and ``times`` (3 or more) of its smallest period or more.
    ``collapsed`` is the text without what a run repeats, its words joined by
    one space. Null and blank texts have no runs, a null strongest run and an
    empty collapsed text. Every row is taken for itself, so equal rows and rows
    without id stay. The text column need not be kept. A kept column named
    like a result is refused. An empty table gives no rows.
    """
    if times < 3:
        raise ValueError("a run has three periods or more")
    names = ["runs", "strongest", "collapsed"]
    if clash := set(names) & {c.lower() for c in keep}:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}")
    plain = docs.select(docs[text_col].cast("string").cast("binary").alias("__text"), *[docs[c] for c in keep])
    schema = docs.select(*keep).schema.add("runs", T.ArrayType(RUN)).add("strongest", RUN).add("collapsed", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "__text", SLICE_BYTES):
                texts = [(t or b"").split() for t in part.column("__text").to_pylist()]
                found = find_runs(texts, least, times)
                short = [b" ".join(t) if not r else b" ".join([t[i] for i in np.flatnonzero(kept_words(len(t), r)).tolist()]) for t, r in zip(texts, found)]
                best = [None if (b := strongest(r)) is None else _as_run(b) for r in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array([[_as_run(x) for x in r] for r in found], pa.list_(_RUN)), pa.array(best, _RUN), pa.array(short, pa.binary())],
                    [*keep, *names])

    found = plain.mapInArrow(run, schema)
    return found.withColumn("collapsed", found["collapsed"].cast("string"))
