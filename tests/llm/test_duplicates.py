import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from caselens.llm import alike, fingerprint, neardup, setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_groups(fps, ids, radius=3):
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(fps))]
        if new == label:
            break
        label = new
    least = {}
    for g, i in zip(label, ids):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in label]


def test_simhash():
    for t in [None, "", "a", "A b", "one two three", "É è é Z z", "a b c d " * 30, "x\x0by\x1cz   q"]:
        assert neardup.simhash(t) & (1 << 64) - 1 == brute_simhash(t)


@pytest.mark.parametrize("block", [4, 64])
def test_index_finds_every_link(spark, block):
    r = random.Random(block)
    seeds = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(r.choice([0, 1, 6])):
            for _ in range(r.randint(1, 3)):
                s ^= 1 << r.randrange(64)
            fps.add(s)
    fps = sorted(fps)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "__fp long, doc_id long")
    links = neardup.stars(neardup.edges(rows.select(F.col("__fp").alias("fp")), 3, block))
    root = {r.u: r.root for r in links.collect()}
    want = brute_groups(fps, signed)
    assert [root.get(s, s) for s in signed] == want


def test_gray_order(spark):
    codes = [n ^ n >> 1 for n in range(64)]
    rows = spark.createDataFrame([(c, n) for n, c in enumerate(codes)], "c long, n long").orderBy(neardup.gray_rank(F.col("c")))
    assert [r.n for r in rows.collect()] == list(range(64))


def test_chain_of_links(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in random.Random(1).sample(range(n), n)], "u long, v long")
    got = {r.u: r.root for r in neardup.stars(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}


def test_documents(spark, sf, edge):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), edge):
        rows = docs.select("doc_id", "text").collect()
        fps = [brute_simhash(r.text) for r in rows]
        want = sorted((r.doc_id or -1, f"{f:016x}", g or -1) for r, f, g in zip(rows, fps, brute_groups(fps, [r.doc_id for r in rows])))
        got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in neardup.near_duplicates(docs).collect())
        assert got == want


def test_one_of_each_group_stays(edge, nothing):
    kept = neardup.keep_one(edge)
    assert kept.columns == edge.columns
    # 1 and 10 differ in case only; the empty, null and blank texts are alike
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 5, 7, 9, 11]
    assert neardup.keep_one(nothing).count() == 0 and neardup.near_duplicates(nothing).count() == 0


def order_of(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))


def test_edited_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id") * 37 - 2000)  # gaps and negative ids
    rows = order_of(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprint.readable(fingerprint.edited_pairs(docs)).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        k = len(r.text) // 3
        text = r.text[: len(r.text) - k] + after.text[:k]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(text.encode()).hexdigest())
        d = (int(g.fingerprint, 16) ^ int(got[after.doc_id].fingerprint, 16)).bit_count()
        assert g.near_next == pytest.approx(max(0, math.cos(math.pi * d / 64)), abs=1e-9)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def brute_weighted(text):
    votes, total = [0] * 64, 0
    for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()):
        weight = 0 if not w else min(max(3 * len(w) - 8, 1), 16)
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        total += weight
        for i in range(64):
            votes[i] += weight * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_votes_and_edge_rows(edge, nothing):
    got = fingerprint.readable(fingerprint.edited_pairs(edge)).collect()
    assert len(got) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect()}
    for r in got:
        assert int(r.fingerprint, 16) == brute_weighted(texts[r.doc_id]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprint.edited_pairs(nothing).count() == 0
    one = fingerprint.edited_pairs(edge.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 5), (2, 6)])
def test_block_tables_find_all(spark, radius, blocks):
    r = random.Random(blocks)
    fps = [r.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for f in fps for _ in range(4)]
    signed = sorted({f - (1 << 64) * (f >> 63) for f in fps})
    stored = spark.createDataFrame([(f,) for f in signed], "fp long")
    asked = stored.filter("fp % 3 = 0")
    got = {(a.query_fp, a.fp) for a in fingerprint.within(asked, stored, radius, blocks).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed if a % 3 == 0 for b in signed if ((a ^ b) & mask).bit_count() <= radius}
    with pytest.raises(ValueError):
        fingerprint.masks(3, 3)


def test_neighbours_counted(spark, sf):
    rows = fingerprint.edited_pairs(spark.read.parquet(f"{sf}/documents.parquet"))
    got = fingerprint.with_neighbours(rows, F.col("doc_id") % 10 == 0).collect()
    mask = (1 << 64) - 1
    for r in got:
        want = sum(((r.fp ^ s.fp) & mask).bit_count() <= 3 for s in got) if r.doc_id % 10 == 0 else None
        assert r.near_docs == want


def brute_kept(rows):
    def grams(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), g in zip(rows, label):
        least[g] = min(i, least.get(g, i))
    return sorted(least.values())


@pytest.mark.parametrize("few", [8, 2])
def test_pipeline_drops_near_copies(spark, sf, few):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, line = [], " ".join(word() for _ in range(40))
    for base in range(20):
        words = [word() for _ in range(r.choice([30, 120, 300]))]
        rows.append(words)
        for _ in range(30 if base == 0 else 4):  # from about 0.95 down to below 0.8
            copy = list(words)
            for at in r.sample(range(len(copy)), max(1, round(len(copy) * r.choice([0.005, 0.01, 0.02, 0.03])))):
                copy[at] = word()
            rows.append(copy)
        rows.append(words[: len(words) // 2] + line.split())
    rows = [(i * 7 % 997, " ".join(w)) for i, w in enumerate(rows)] + [(1000, "one two"), (1001, "One  two"), (1002, "one two three four five"), (1003, ""), (1004, " ")]
    rows += [(2000 + i, r_.text) for i, r_ in enumerate(spark.read.parquet(f"{sf}/documents.parquet").collect())]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_kept(rows)
    assert len(want) < len(rows) - 60
    assert sorted(x.doc_id for x in alike.keep_one(docs, few=few, block=8).collect()) == want
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == want
    assert alike.keep_one(docs.filter("doc_id < 0")).count() == 0


def test_pipeline_keeps_one_of_edge_rows(edge):
    kept = alike.keep_one(edge)
    assert kept.columns == edge.columns
    # 1 and 10 differ in case only, 7 stands twice; texts without words all stay
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 9, 11]


def test_close_fingerprints_alone_are_near_duplicates(spark):
    r = random.Random(275)
    n = r.randint(40, 60)
    words = [f"w{r.randrange(10**6)}" for _ in range(n)]
    copy = list(words)
    copy[r.randint(8, n - 8)] = "x"
    copy = copy[: n - r.randint(0, 2)]
    sets = setjoin.shingle_sets([" ".join(words), " ".join(copy)])
    assert not setjoin.alike(*sets) and bin((int(setjoin.majority(sets[0])) ^ int(setjoin.majority(sets[1]))) & (1 << 64) - 1).count("1") <= neardup.RADIUS
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, "something else entirely in these seven words")], "doc_id long, text string")
    assert sorted(x.doc_id for x in alike.keep_one(docs).collect()) == [1, 3]
