import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import queries, setjoin
from caselens.llm.common import ARROW_BYTES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [brute_set(r.text) for r in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in holders[x]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r.doc_id is not None:
            least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return sorted(((r.doc_id, len(s), least.get(find(i)) if s else r.doc_id) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sets():
    texts = ["a b c d e f a b c d e", "A b", "a B ", "", None, "x\x0by\x1cz  q", "one two three four five", "é É z Z w v", "a b c d e f g " * 300]
    found = setjoin.shingle_sets(texts)
    assert [len(x) for x in found] == [len(brute_set(t)) for t in texts]
    assert (found[1] == found[2]).all() and all((np.diff(x.view(np.int64).astype(object) % (1 << 64)) > 0).all() for x in found)
    again = setjoin.shingle_sets(texts[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(found, again))


def random_sets(seed, n):
    r = np.random.default_rng(seed)
    for _ in range(n):
        a = r.integers(0, 1 << 62, r.integers(1, 90), np.uint64)
        b = np.concatenate([a[r.random(len(a)) < 0.93], r.integers(0, 1 << 62, r.integers(0, 5), np.uint64)])
        yield np.unique(a), np.unique(b)


@pytest.mark.parametrize("bound", setjoin.BOUNDS)
def test_alike_sets_meet_and_pass(bound):
    met = 0
    for a, b in random_sets(bound, 3000):
        if len(b) and setjoin.alike(a, b) and len(np.setxor1d(a, b)):
            common = np.sort(a[: len(a) // 2])
            sigs = [setjoin.signatures(setjoin.in_order(x, common, np.arange(len(common)) + 2), bound) for x in (a, b)]
            small = len(a) <= bound and len(b) <= bound
            assert len(np.intersect1d(*[s[0 if small else 1] for s in sigs]))
            assert setjoin.fits(len(a), len(b))
            x, y = setjoin.sketch(a), setjoin.sketch(b)
            w = min(len(x), len(y))
            assert np.bitwise_count(setjoin.folded(x, w) ^ setjoin.folded(y, w)).sum() <= setjoin.may_differ(len(a) + len(b)) >= len(np.setxor1d(a, b))
            met += 1
    assert met > 500


def near_copies(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    rows, i = [], 0
    for size, copies in [(5, 6), (8, 6), (9, 12), (14, 10), (30, 40), (60, 30), (70, 8), (150, 70), (400, 12), (1500, 3)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, size // 30])):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = [word()] * r.randint(0, 1)
            rows.append((i * 7 % 1009, " ".join(w)))
            i += 1
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + k, f"{word()} {word()} {passage} {' '.join(word() for _ in range(r.randint(0, 60)))}") for k in range(120)]
    return rows


@pytest.mark.parametrize("few,block", [(32, 512), (4, 8)])
def test_near_copies_and_shared_passages(spark, few, block):
    df = spark.createDataFrame(near_copies(few), "doc_id long, text string").repartition(5)
    rows = df.collect()
    want = brute(rows)
    assert got(setjoin.jaccard_join(df, few=few, block=block)) == want
    assert len({r[2] for r in want}) < len(want) - 100


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got(queries.op12(spark, sf)) == brute(rows)


def test_edge_rows(edge, nothing):
    assert got(setjoin.jaccard_join(edge)) == brute(edge.select("doc_id", "text").collect())
    assert setjoin.jaccard_join(nothing).collect() == []


def test_texts_come_in_bounded_batches(spark, monkeypatch):
    """What a session hands Python at a time by itself, 10,000 rows, is more than an executor has room for if texts are long."""
    plain, most = setjoin.tidied, 12 << 20

    def watched(run):
        def held(batches):
            for batch in batches:
                assert batch.nbytes < most
                yield batch

        return plain(lambda batches: run(held(batches)))

    monkeypatch.setattr(setjoin, "tidied", watched)
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(64 << 20))
    try:
        docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 20_000).alias("text"))
        found = setjoin.jaccard_join(docs).collect()
        assert sorted(map(tuple, found)) == [(i, 1, i) for i in range(200)]
    finally:
        spark.conf.set(ARROW_BYTES, before)
