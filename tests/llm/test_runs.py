import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from caselens.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=24, times=3):
    if len(set(w)) == 1:
        return [(0, len(w), 1)] if len(w) >= max(least, times) else []
    out, seen = [], set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - start + q
            if n >= max(least, times * q) and (start, n) not in seen:  # periods ascend: the first one is the smallest
                seen.add((start, n))
                out.append((start, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(seed, texts):
    r = random.Random(seed)
    for _ in range(texts):
        names = r.choice([1, 2, 3, 50])
        w = [b"%d" % r.randrange(names) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            i, p = r.randint(0, len(w)), [b"%d" % r.randrange(names) for _ in range(r.randint(1, 9))]
            w[i:i] = (p * 30)[: r.randint(10, 60)]
        yield w


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (3, 3), (7, 4)])
def test_every_run_and_no_other(least, times):
    texts = list(made_up(least, 400))
    found = [x for i in range(0, 400, 23) for x in runs.find_runs(texts[i : i + 23], least, times)]
    assert found == [brute_runs(t, least, times) for t in texts]
    assert sum(map(len, found)) > 300


def test_long_texts():
    assert runs.find_runs([[b"w"] * 60_000, [], [b"a", b"b"] * 30_000]) == [[(0, 60_000, 1)], [], [(0, 60_000, 2)]]
    line = [b"%d" % i for i in range(50)]
    same = [w for i in range(4000) for w in [b"n%d" % i, *line]]  # one line after 4,000 different words: no run
    assert runs.find_runs([same]) == [[]]


def test_leaves_of_places():
    r = random.Random(3)
    held = r.sample(range(20_000), 6000)
    places = runs.Places(held[0])
    for x in held[1:]:
        places.add(x)
    assert list(places) == sorted(held) and max(map(len, places.leaves)) <= runs.LEAF
    for x in range(-1, 20_002, 7):
        assert places.at_least(x) == min((y for y in held if y >= x), default=None)


def test_strongest_is_exact():
    third = [(0, 3 * 10**17 + 1, 10**17), (5, 3 * 10**17 + 2, 10**17), (9, 6 * 10**17 + 4, 2 * 10**17)]
    assert runs.strongest(third) == third[1] and runs.strongest([]) is None


def want(doc_id, text):
    w = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, sf):
    got = sorted(tuple(r) for r in queries.op11(spark, sf).select(*NAMES).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(want(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10
    assert queries.op11(spark, sf).schema.simpleString().startswith("struct<doc_id:bigint,n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,runs_sha256:string")


def test_edge_rows(spark, edge, nothing, tmp_path):
    for docs, name in ((edge, "a"), (nothing, "b")):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [tuple(r) for r in queries.op11(spark, f"{tmp_path}/{name}").select(*NAMES).collect()]
        assert sorted(map(str, got)) == sorted(str(want(r.doc_id, r.text)) for r in docs.collect())
    found = {r.doc_id: r for r in runs.periodic_runs(edge, ["doc_id", "start", "size", "text"]).collect()}
    assert found[5].collapsed == "word" and found[5].strongest.length == 60_000 and found[2].runs == [] and found[2].collapsed == ""
    with pytest.raises(ValueError):
        runs.periodic_runs(edge.withColumnRenamed("start", "Runs"), ["Runs"])
    with pytest.raises(ValueError):
        runs.periodic_runs(edge, ["doc_id"], times=2)
