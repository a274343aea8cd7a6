"""Ordered operators against plain Python, with one hot group."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import ordered as od
from caselens.operators.audit import GENESIS, append, verify

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(rows, "case_id string, event_id string, ts timestamp_ntz, severity string, is_anomaly boolean")


def hot_rows(n=900, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        case = "hot" if i % 3 == 0 else f"c{rnd.randrange(40)}"
        # the hot case has many equal timestamps
        t = T0 + dt.timedelta(minutes=5 * rnd.randrange(20) if case == "hot" else rnd.randrange(3000))
        rows.append((case, f"e{i:04d}", t, rnd.choice(["info", "low"]), False))
    return rows


def test_ordered_index_is_dense_and_sorted(spark):
    rows = hot_rows()
    got = od.ordered_index(events(spark, rows), ["case_id"], [F.asc("ts"), F.asc("event_id")]).collect()
    want = {}
    for case in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == case), key=lambda r: (r[2], r[1])), 1):
            want[r[1]] = i
    assert {r.event_id: r.pos for r in got} == want


def test_deep_top_n_equals_sort(spark):
    rows = [("hot", f"e{i:05d}", T0 + dt.timedelta(seconds=i % 700), "info", False) for i in range(3000)]
    got = od.top_n(events(spark, rows), ["case_id"], [F.desc("ts"), F.asc("event_id")], 1500)
    want = sorted(rows, key=lambda r: (-r[2].timestamp(), r[1]))[:1500]
    assert {r.event_id for r in got.collect()} == {r[1] for r in want}


def test_pages_clamp_and_cover(spark):
    rows = [("c", f"e{i:03d}", T0 + dt.timedelta(seconds=i), "info", False) for i in range(25)]
    ev = events(spark, rows)
    seen = []
    for p in (1, 2, 3):
        out = od.page(ev, ["case_id"], True, p, 3).orderBy("rank").collect()  # limit is clamped to 10
        assert all((r.total, r.total_pages) == (25, 3) for r in out)
        seen += [r.event_id for r in out]
    assert seen == [f"e{i:03d}" for i in reversed(range(25))]


def test_session_gap_is_strict(spark):
    minutes = [0, 15, 30, 46, 47, 100]
    rows = [("c", str(i), T0 + dt.timedelta(minutes=m), "info", False) for i, m in enumerate(minutes)]
    got = [(r.session_no, r.event_count) for r in od.sessions(events(spark, rows), ["case_id"]).orderBy("session_no").collect()]
    assert got == [(1, 3), (2, 2), (3, 1)]


def test_sessions_match_brute_force(spark):
    rows = hot_rows(600, 5)
    got = {(r.case_id, r.start_ts, r.end_ts, r.event_count) for r in od.sessions(events(spark, rows), ["case_id"]).collect()}
    want = set()
    for case in {r[0] for r in rows}:
        ts = sorted(r[2] for r in rows if r[0] == case)
        start = prev = ts[0]
        n = 1
        for t in ts[1:]:
            if t - prev > dt.timedelta(minutes=15):
                want.add((case, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        want.add((case, start, prev, n))
    assert got == want


def plain_milestones(evs, n=12):
    evs = sorted(evs, key=lambda r: (r[2], r[1]))
    keys = [e for e in evs if e[4] or e[3] in ("critical", "high")]
    if len(keys) < n:
        need = n - len(keys)
        step = max(1, len(evs) // need)
        for e in evs[::step]:
            if e not in keys and len(keys) < n:
                keys.append(e)
    return {e[1] for e in sorted(keys, key=lambda r: (r[2], r[1]))[:n]}


@pytest.mark.parametrize("n_events,n_key", [(5, 1), (40, 3), (200, 0), (60, 30)])
def test_milestones_fill(spark, n_events, n_key):
    rows = [("c", f"e{i:03d}", T0 + dt.timedelta(minutes=i), "high" if i * n_key // n_events != (i - 1) * n_key // n_events else "info", False)
            for i in range(n_events)]
    got = {r.event_id for r in od.milestones(events(spark, rows)).collect()}
    assert got == plain_milestones(rows)


def test_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    rows = [("hot", float(rnd.choice([0, 0, 0, 1, 2]))) for _ in range(400)] + [("b", rnd.random()) for _ in range(37)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.05, 0.5, 0.95):
        got = {r.g: r.quantile for r in od.quantiles(df, ["g"], "v", F.lit(q)).collect()}
        for g in ("hot", "b", "one"):
            assert got[g] == pytest.approx(np.percentile([v for k, v in rows if k == g], 100 * q))


def audit(spark, n, start=0):
    return spark.createDataFrame(
        [(f"a{i:04d}", "u", "org", "act", "evidence", "e", "{}", f"2024-01-01T00:00:{i:06d}") for i in range(start, start + n)],
        "audit_id string, actor_id string, organization_id string, action string, entity_type string, entity_id string, metadata string, created_at string")


@pytest.mark.parametrize("segment", [4, 256])
def test_audit_chain_append_verify_and_tamper(spark, segment):
    log = append(audit(spark, 20), segment=segment).cache()
    more = append(audit(spark, 10, 20), stored=log, segment=segment)
    last = append(audit(spark, 3, 30), stored=log.unionByName(more), segment=segment)
    full = log.unionByName(more).unionByName(last).cache()
    # in three parts or at once: the same chain
    at_once = append(audit(spark, 33), segment=segment)
    key = lambda df: sorted((r.audit_id, r.prev_hash, r.self_hash) for r in df.collect())
    assert key(full) == key(at_once)
    ok = verify(full, segment).first()
    assert (ok.valid, ok.total, ok.broken_at) == (True, 33, None)
    for at in (1, 5, 6, 8, 9, 13, 33):  # first, middle and last rows of segments
        name = f"a{at - 1:04d}"
        bad = verify(full.withColumn("action", F.when(F.col("audit_id") == name, "x").otherwise(F.col("action"))), segment).first()
        assert (bad.valid, bad.broken_at, bad.broken_id) == (False, at, name)
    gone = verify(full.filter("audit_id <> 'a0007'"), segment).first()
    assert (gone.valid, gone.broken_at, gone.broken_id) == (False, 8, "a0008")


def test_a_segment_made_anew_breaks_the_next_seed(spark):
    changed = audit(spark, 12).withColumn("action", F.when(F.col("audit_id") == "a0005", "x").otherwise(F.col("action")))
    log, forged = append(audit(spark, 12), segment=4), append(changed, segment=4)
    mixed = log.filter("audit_id < 'a0004' or audit_id >= 'a0008'").unionByName(forged.filter("audit_id >= 'a0004' and audit_id < 'a0008'"))
    bad = verify(mixed, 4).first()
    assert (bad.valid, bad.broken_at, bad.broken_id) == (False, 9, "a0008")


def test_no_task_links_more_than_a_segment(spark):
    """A log of one organization is dealt out by segment; the chain equals a plain loop over it."""
    rows = audit(spark, 1500)
    got = {r.audit_id: (r.prev_hash, r.self_hash) for r in append(rows, segment=100).collect()}
    digests = {r.audit_id: r.digest for r in rows.withColumn("digest", od.audit_digest()).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    seed, names = GENESIS, sorted(digests)
    for s in range(0, 1500, 100):
        prev = seed
        for n in names[s : s + 100]:
            assert got[n] == (prev, sha(prev + digests[n]))
            prev = got[n][1]
        seed = sha(seed + sha("".join(digests[n] for n in names[s : s + 100])))
