import hashlib
import random
import re
import zlib

from caselens.llm import common, prefixtrie, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DDL = "conv_id long, turn long, role string, text string, depth string, n_convs string, pos string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, base=lambda c: c - c % 20, take=lambda c: zlib.crc32(str(c).encode()) % 4):
    own = {}
    for r in rows:
        if r.conv_id is not None:
            own.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", digest(r.role or "", r.text or ""), r.text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v, key=lambda t: t[:4])] for c, v in own.items()}
    built = {c: tuple(own.get(base(c), [])[: take(c)] + v[take(c) :]) for c, v in own.items()}
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        inner = {x[:-1] for x in below if len(x) > len(node)}
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(node))))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(x) == len(node) + 1 for x in below),
                    sum(x not in inner for x in below), sum((len(nodes[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert got(queries.op13(spark, sf)) == brute(rows)


def some(seed, n):
    r = random.Random(seed)
    say = ["", None, "a b", "a  b c", "x\x0by z", "long " * 2000]
    for c in r.sample(range(90), n):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            yield (c, r.choice([t, t, None, 2]), r.choice(["user", None, ""]), r.choice(say), "d", "n", "p")


def test_ties_nulls_and_clashing_names(spark, tmp_path):
    data = [*some(1, 60), (None, 0, "user", "no conversation", "d", "n", "p")]
    data += data[:9]
    for partitions in (1, 7):
        df = spark.createDataFrame(data, DDL).repartition(partitions)
        df.write.parquet(f"{tmp_path}/{partitions}/conversations.parquet")
        assert got(queries.op13(spark, f"{tmp_path}/{partitions}")) == brute(df.collect())


def test_hot_turns_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    monkeypatch.setattr(common, "HEAVY", 5)  # so that some keys are heavy and some are not
    data = [(c, t, "user", f"turn {t}" if c % 3 else f"turn {t} {c % 5}", "d", "n", "p") for c in range(300) for t in range(2 + c % 2)]
    data += [(1000, t, "assistant", f"{t % 3}", "d", "n", "p") for t in range(900)]  # one conversation holds half of all turns
    df = spark.createDataFrame(data, DDL)
    shared = (lambda c: c * 0, lambda c: c % 3)
    assert got(prefixtrie.prefix_trie(df, *shared)) == brute(df.collect(), lambda c: 0, lambda c: c % 3)


def test_empty_table(spark):
    assert queries.prefixtrie.prefix_trie(spark.createDataFrame([], DDL), lambda c: c, lambda c: c * 0).collect() == []


def test_collisions_are_seen(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "MODULI", (19, 2, 2))  # many sequences collide
    df = spark.createDataFrame(list(some(2, 40)), DDL)
    try:
        found = got(prefixtrie.prefix_trie(df, lambda c: c - c % 20, lambda c: c % 4, seeds=2))
    except RuntimeError:
        return
    assert found == brute(df.collect(), take=lambda c: c % 4)
