"""Isolation, replacement, reconciliation, ensemble, streams and the query contract."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caselens.operators import aggregates as ag
from caselens.operators import anomaly as an
from caselens.operators import describe as de
from caselens.operators import vectors as ve
from caselens.operators.context import top_anomalies
from caselens.schema import conform
from caselens.sources import store as st
from caselens.streaming import alerts
from caselens.streaming import streams as ss

T0 = dt.datetime(2024, 1, 1)


def rows(spark, case, evid, n, start=0, severity="info"):
    return conform(spark.range(start, start + n).select(
        F.concat(F.lit(f"{case}-{evid}-"), F.col("id").cast("string")).alias("event_id"), F.lit(case).alias("case_id"), F.lit(evid).alias("evidence_id"),
        F.lit("s").alias("subject"), F.lit(severity).alias("severity"), F.lit(T0).cast("timestamp_ntz").alias("ts")))


def totals(spark, path):
    out = ag.stats(st.read_events(spark, path)).collect()
    return {(r.case_id, r.evidence_id): r.total for r in out}


def test_reprocess_replaces_one_file_only(spark, tmp_path):
    path = str(tmp_path / "events")
    st.append_events(rows(spark, "A", "a1", 100).unionByName(rows(spark, "B", "b1", 75)).unionByName(rows(spark, "A", "a2", 60)), path)
    for _ in range(3):
        st.replace_events(rows(spark, "A", "a1", 50), path)
    t = totals(spark, path)
    assert (t[("A", "a1")], t[("A", "a2")], t[("A", None)], t[("B", None)]) == (50, 60, 110, 75)


def test_small_case_rules(spark):
    df = rows(spark, "A", "a", 2, severity="high").unionByName(rows(spark, "A", "a", 2, 10)).unionByName(rows(spark, "B", "b", 9))
    got = {(r.event_id, r.flag, r.score) for r in an.small_cases(df).collect()}
    assert got == {("A-a-0", True, 0.85), ("A-a-1", True, 0.85), ("A-a-10", False, 0.4), ("A-a-11", False, 0.4)}


def brute_lof(x, k):
    """Published definition: all points within the k-distance are neighbours."""
    n = len(x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, axis=1)[:, k - 1]
    nb = [np.flatnonzero(d[i] <= kd[i]) for i in range(n)]
    lrd = np.array([1 / (np.maximum(kd[nb[i]], d[i, nb[i]]).mean() + 1e-10) for i in range(n)])
    return np.array([lrd[nb[i]].mean() / lrd[i] for i in range(n)])


@pytest.mark.parametrize("kind", ["mixed", "duplicates"])
def test_lof_matches_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "mixed":
        x = np.column_stack([rng.integers(0, 24, 80), rng.integers(0, 2, 80), *rng.random((3, 80)).round(3) * 0.2, rng.choice([0, .25, .5], 80)])
    else:
        x = np.repeat(np.column_stack([rng.integers(0, 24, 20), np.zeros(20), *rng.random((3, 20)).round(2), np.zeros(20)]), 4, axis=0)
        x = np.vstack([x, x[:1].repeat(15, axis=0)])
    x = x.astype(float)
    df = spark.createDataFrame([("c", str(i), *map(float, r)) for i, r in enumerate(x)], "case_id string, event_id string, " + ", ".join(f"{f} double" for f in an.FEATURES))
    got = {int(r.event_id): r.score for r in an.lof(df, busy_cell=8).collect()}
    keep = x.var(axis=0) > 1e-10
    k = min(10, len(np.unique(x[:, keep], axis=0)) - 1)
    raw = np.round(brute_lof(x[:, keep], k), 6)
    want = (raw - raw.min()) / (raw.max() - raw.min())
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-4)


def test_lof_grid_is_as_fine_as_frequencies_of_large_cases(spark):
    """Frequencies a millionth apart, as in cases of a million events, are parted by the first grid; scores stay those of brute force."""
    rng = np.random.default_rng(3)
    at = rng.choice(900, 300, replace=False)
    x = np.zeros((300, 6))
    x[:, 2], x[:, 3] = 0.01 + (at % 30) * 1e-5, 0.02 + (at // 30) * 1e-5
    rows = spark.createDataFrame([("c", str(i), *map(float, r)) for i, r in enumerate(x)], "case_id string, event_id string, " + ", ".join(f"{f} double" for f in an.FEATURES))
    i = an._first_width(rows, [F.col(f) for f in an.FEATURES], 8)
    cells = np.unique(np.floor(x[:, 2:4] / an.WIDTHS[i]), axis=0, return_counts=True)[1]
    assert cells.max() <= 8
    # equal numbers of far larger variance make no feature constant
    wide = np.vstack([x, [[0, 0, 0.9, 0.9, 0, 0]] * 15])
    rows = spark.createDataFrame([("c", str(i), *map(float, r)) for i, r in enumerate(wide)], "case_id string, event_id string, " + ", ".join(f"{f} double" for f in an.FEATURES))
    got = {int(r.event_id): r.score for r in an.lof(rows, busy_cell=8).collect()}
    raw = np.round(brute_lof(wide, 10), 6)
    want = (raw - raw.min()) / (raw.max() - raw.min())
    assert np.allclose([got[i] for i in range(len(wide))], want, atol=1e-4)


def test_lof_neutral_when_constant(spark):
    df = spark.createDataFrame([("c", str(i), 1.0, 0.0, 0.5, 0.5, 0.5, 0.0) for i in range(8)], "case_id string, event_id string, " + ", ".join(f"{f} double" for f in an.FEATURES))
    assert {(r.flag, r.score) for r in an.lof(df).collect()} == {(False, 0.0)}


def test_forest_properties(spark):
    rng = np.random.default_rng(1)
    data = [("c", f"{i:04d}", *map(float, v)) for i, v in enumerate(rng.normal(0, 1, (600, 6)))] + [("c", "far", *[9.0] * 6)]
    df = spark.createDataFrame(data, "case_id string, event_id string, " + ", ".join(f"{f} double" for f in an.FEATURES))
    trees = an.fit_forest(df, trees=20, sample=64)
    assert trees.select("tree_id").distinct().count() == 20
    out = {r.event_id: r for r in an.isolation_forest(df, trees, df, sample=64, trees=20).collect()}
    assert all(0 <= r.score <= 1 for r in out.values()) and out["far"].score > 0.9 and out["far"].flag


def test_vote_divides_by_all_models(spark):
    df = spark.createDataFrame([("c", "1", "a", True, 0.9), ("c", "1", "b", True, 0.6), ("c", "2", "a", True, 0.3)], "case_id string, event_id string, model string, flag boolean, score double")
    got = {r.event_id: (r.flag, round(r.score, 6)) for r in an.vote(df).collect()}
    assert got == {"1": (True, 0.5), "2": (False, 0.1)}


def test_top_anomaly_fallback_by_level(spark):
    df = rows(spark, "A", "a", 1, 0, "critical").unionByName(rows(spark, "A", "b", 1, 0, "medium"))
    assert [r.severity for r in top_anomalies(df, 1).collect()] == ["critical"]
    assert [r.severity for r in top_anomalies(df, 1, compat=True).collect()] == ["medium"]


def test_topk_blocks_equal_one_block(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(f"{i:03d}", list(map(float, x))) for i, x in enumerate(rng.normal(size=(90, 8)))], "id string, embedding array<float>")
    q = v.limit(7).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    one = {(r.query_id, r.id, r.rank) for r in ve.topk_all(v, q, 5).collect()}
    many = {(r.query_id, r.id, r.rank) for r in ve.topk_all(v, q, 5, block=20, query_block=2).collect()}
    assert one == many and len(one) == 35


def clustered(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, n)] + 0.2 * rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([("hot" if i % 3 else f"c{i % 5}", f"{i:04d}", list(map(float, r))) for i, r in enumerate(x)], "case_id string, id string, embedding array<float>")


def test_topk_in_case_in_blocks(spark):
    v = clustered(spark)
    q = v.filter("id % 50 = 0").select("case_id", F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    rows, want = v.collect(), set()
    for a in q.collect():
        found = sorted((-round(float(np.dot(np.float64(a.query), np.float64(r.embedding))), 9), r.id) for r in rows if r.case_id == a.case_id)[:7]
        want |= {(a.query_id, i, n + 1) for n, (_, i) in enumerate(found)}
    for block, asked in ((10_000, 100), (40, 3)):
        assert {(r.query_id, r.id, r["rank"]) for r in ve.topk_in_case(v, q, 7, block, asked).collect()} == want
    assert ve.topk_in_case(v.filter("id < 0"), q, 7).count() == 0


def test_near_search_finds_most_in_few_cells(spark):
    v = clustered(spark).select("id", "embedding")
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    centre = ve.fit_centroids(v, 24)
    lists = ve.inverted_lists(v, centre).cache()
    assert lists.count() == v.count()
    probes = ve.probes_for(lists, centre, v.filter("id % 20 = 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 5, 0.95)
    assert probes <= 8
    told = ve.recall(ve.topk_near(lists, centre, q, 5, probes, block=50, query_block=9), ve.topk_all(v, q, 5)).first()
    assert told["of"] == 150 and told["hits"] >= 135
    all_cells = ve.recall(ve.topk_near(lists, centre, q, 5, len(centre)), ve.topk_all(v, q, 5)).first()
    assert all_cells["hits"] == all_cells["of"]


def test_idf_weights(spark):
    df = spark.createDataFrame([(1, "the cat the_hat"), (2, "The dog"), (3, "the"), (4, ""), (5, None)], "k int, sentence string")
    model = ve.document_frequencies(df).cache()
    got = {r.k: np.array(r.embedding) for r in ve.hashed_embedding(df, model=model).collect()}
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % ve.DIM
    idf = {w: np.log(6 / (n + 1)) for w, n in (("the", 3), ("cat", 1), ("the_hat", 1), ("dog", 1))}
    for k, words in ((1, ["the", "cat", "the_hat"]), (2, ["the", "dog"]), (3, ["the"]), (4, []), (5, [])):
        want = np.zeros(ve.DIM)
        for w in words:
            want[place(w)] = idf[w]
        assert got[k] == pytest.approx(want / (np.linalg.norm(want) or 1), abs=1e-6)
    # a kept model gives new texts the corpus' weights; an unknown word weighs most
    new = ve.hashed_embedding(spark.createDataFrame([("the bird",)], "sentence string"), model=model).first().embedding
    assert new[place("bird")] == pytest.approx(np.log(6) / np.hypot(np.log(6), idf["the"]), abs=1e-6)


def test_encoder_embedding_is_unit(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "sentence string")
    out = ve.encoder_embedding(df, lambda: (lambda texts: np.array([[len(t), 3.0] for t in texts]))).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in out)


def test_scan_time_rules(spark):
    df = spark.createDataFrame([
        ("stored", "parsed", 5000, None, None, T0, None), ("measured", "failed", None, T0, T0 + dt.timedelta(seconds=8), T0, None),
        ("clamped", "parsed", None, None, None, T0, T0 + dt.timedelta(milliseconds=200)), ("unknown", "parsed", None, None, None, T0, None),
        ("running", "parsing", 7, T0, None, T0, None)],
        "k string, status string, scan_duration_ms long, processing_started_at timestamp_ntz, processing_finished_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")
    assert {r[0]: r[1] for r in df.select("k", de.scan_ms()).collect()} == {"stored": 5000, "measured": 8000, "clamped": 1000, "unknown": 2000, "running": None}


def test_status_timer_restarts(spark):
    c = [("e", "parsing", 1_000_000), ("e", "parsed", 6_000_000), ("f", "parsing", 0), ("f", "parsed", 5_000_000), ("f", "parsing", 9_000_000)]
    got = {r.evidence_id: (r.status, r.scan_ms) for r in ss.latest_status(spark.createDataFrame(c, "evidence_id string, status string, at_us long")).collect()}
    assert got == {"e": ("parsed", 5000), "f": ("parsing", None)}


def test_brute_force_counts_across_slots(spark):
    secs = [0, 55, 58, 59, 61, 62, 63, 64, 65, 66, 200]
    df = spark.createDataFrame([("1.1.1.1", str(i), T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)], "ip string, event_id string, ts timestamp_ntz")
    got = {r.event_id: r.failures for r in alerts.brute_force(df, threshold=8).collect()}
    want = {}
    for i, s in enumerate(secs):
        n = sum(1 for t in secs if s - 60 <= t <= s)
        if n >= 8:
            want[str(i)] = n
    assert got == want and want


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rows(spark, "A", "a1", 30).unionByName(rows(spark, "B", "b1", 12)).write.parquet(path)
    src = ss.file_stream(spark, path, spark.read.parquet(path).schema)
    live = {(r.case_id, r.evidence_id): r.total for r in ss.run_once(ss.counters(src), "complete").collect()}
    assert live == {("A", "a1"): 30, ("B", "b1"): 12}


def test_every_query_has_a_stable_name_and_oracle_subset():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 160


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["case_id", "evidence_id", "total", "total_processed", "anomalies", "critical"] and df.count() > 0


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    from caselens import session

    conf = {"spark.checkpoint.dir": None}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, v=None: conf.get(k) or v), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert session.shared_dir(cluster) == "hdfs://x/y"
    conf.clear()
    cluster.sparkContext.getCheckpointDir = lambda: "file:/shared"
    assert session.shared_dir(cluster) == "file:/shared"


def in_batches(spark, tmp_path, rows, schema, name):
    """A stream whose micro-batches are the given lists of rows, in order."""
    import time

    from pyspark.sql.types import _parse_datatype_string

    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(1.1)  # files are taken in the order of their times
    return ss.file_stream(spark, str(tmp_path / name), _parse_datatype_string(schema), per_trigger=1)


def test_file_is_taken_once_for_ever(spark, tmp_path):
    day = lambda n: T0 + dt.timedelta(days=n)
    batches = [[("A", "x", day(9)), ("A", "y", day(9)), ("A", "y", day(8))], [("A", "x", day(20)), ("B", "x", day(1))], [("A", "z", day(0)), ("B", "x", day(30))]]
    files = in_batches(spark, tmp_path, batches, "case_id string, sha256 string, created_at timestamp", "files")
    ss.dedupe(files, str(tmp_path / "held"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "held")).select("case_id", "sha256", F.dayofyear("created_at").alias("d")).collect()
    assert sorted(map(tuple, got)) == [("A", "x", 10), ("A", "y", 9), ("A", "z", 1), ("B", "x", 2)]


def test_late_status_changes_nothing(spark, tmp_path):
    batches = [[("f", "parsing", 100), ("g", "parsing", 100), ("g", "parsed", 300)], [("f", "parsed", 200), ("g", "parsing", 250)], [("f", "parsing", 100), ("f", "queued", 50)]]
    schema = "evidence_id string, status string, at_us long"
    out = ss.run_once(ss.status_stream(in_batches(spark, tmp_path, batches, schema, "status")), "update").collect()
    last = {}
    for r in sorted(out, key=lambda r: r.batch):
        last[r.evidence_id] = (r.status, r.started_us, r.finished_us)
    want = {r.evidence_id: (r.status, r.started_us, r.finished_us) for r in ss.latest_status(spark.createDataFrame([x for b in batches for x in b], schema)).collect()}
    assert last == want and want["f"] == ("parsed", 100, 200)


def test_every_tree_has_its_sample(spark):
    rows = spark.range(1000).select(F.lit("c").alias("case_id"), F.col("id").cast("string").alias("event_id"), *[(F.col("id") % (i + 7)).cast("double").alias(f) for i, f in enumerate(an.FEATURES)])
    for n in (1000, 40):
        counts = an.forest_sample(rows.limit(n), 20, 256).groupBy("tree_id").count().collect()
        assert len(counts) == 20 and {r["count"] for r in counts} == {min(n, 256)}
    assert {r.n_rows for r in an.fit_forest(rows, 5, 256).select("n_rows").collect()} == {256}


def test_trees_follow_from_their_rows(spark):
    """Children hold their parent's rows, cuts part them, leaves end at the depth limit, with one row or without differences; a second fit is equal."""
    rng = np.random.default_rng(7)
    x = np.round(rng.random((300, 6)), 2)
    rows = spark.createDataFrame([("c", f"e{i}", *map(float, r)) for i, r in enumerate(x)], "case_id string, event_id string, " + ", ".join(f"{f} double" for f in an.FEATURES))
    key = lambda df: sorted(map(tuple, df.collect()))
    forest = an.fit_forest(rows, 6, 64).cache()
    assert key(forest) == key(an.fit_forest(rows.repartition(5), 6, 64))
    drawn = {}
    for r in an.forest_sample(rows, 6, 64).collect():
        drawn.setdefault(r.tree_id, []).append(np.array(r.x))
    for t, held in drawn.items():
        nodes = {r.node_id: r for r in forest.filter(F.col("tree_id") == t).collect()}
        at = {1: held}
        for i in sorted(nodes):
            n, inside = nodes[i], np.array(at[i])
            assert n.node_rows == len(inside) and n.n_rows == len(held) == 64
            depth = int(i).bit_length() - 1
            if n.feature < 0:
                assert depth == 6 or len(inside) == 1 or (inside == inside[0]).all()
                assert n.path == pytest.approx(depth + (0 if len(inside) < 2 else 1 if len(inside) == 2 else 2 * (np.log(len(inside) - 1) + np.euler_gamma) - 2 * (len(inside) - 1) / len(inside)))
            else:
                low = inside[:, n.feature] <= n.threshold
                at[2 * i], at[2 * i + 1] = inside[low], inside[~low]
                assert inside[:, n.feature].min() <= n.threshold < inside[:, n.feature].max()


def test_forest_of_a_baseline_scores_other_rows(spark):
    rng = np.random.default_rng(8)
    frame = lambda x, case: spark.createDataFrame([(case, f"{case}{i}", *map(float, r)) for i, r in enumerate(x)], "case_id string, event_id string, " + ", ".join(f"{f} double" for f in an.FEATURES))
    base = frame(rng.normal(0, 0.1, (400, 6)), "b")
    new = frame(np.vstack([rng.normal(0, 0.1, (60, 6)), np.full((3, 6), 2.0)]), "n")
    out = {r.event_id: r for r in an.isolation_forest(new, an.fit_forest(base), base).collect()}
    far = [out[f"n{i}"] for i in (60, 61, 62)]
    assert all(r.flag and r.score == 1.0 for r in far) and np.mean([r.flag for r in out.values()]) < 0.3


def test_a_block_of_vectors_is_searched_in_stripes(monkeypatch):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(ve, "STRIPE", 7)
    r = np.random.default_rng(3)
    m, q = r.integers(-2, 3, (50, 4)).astype(np.float32), r.integers(-2, 3, (6, 4)).astype(np.float32)
    ids = [f"{i:02d}" for i in r.permutation(50)]
    left = pa.table({"id": ids, "embedding": pa.array(list(m), pa.list_(pa.float32()))})
    right = pa.table({"query_id": [str(i) for i in range(6)], "query": pa.array(list(q), pa.list_(pa.float32()))})
    want = [(str(i), b, float(-a)) for i in range(6) for a, b in sorted((-float(x @ q[i]), y) for x, y in zip(m, ids))[:5]]
    assert [tuple(x.values()) for x in ve._best(5)(left, right).to_pylist()] == want
    assert len(ve._best(5)(left.slice(0, 0), right)) == 0


def test_sentences_are_made_once(spark, monkeypatch):
    seen, write = [], ve.materialize
    monkeypatch.setattr(ve, "materialize", lambda df, name="step": seen.append(name) or write(df, name))
    ev = conform(spark.createDataFrame([("e1", "c1", "u", "click"), ("e2", "c1", "u", "click"), ("e3", None, "u", "click")], "event_id string, case_id string, subject string, action string"))
    out = ve.embed_events(ev)
    assert sorted(r.event_id for r in out.collect()) == ["e1", "e2"]
    assert seen == ["sentences", "unique"] and "md5" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bundle_joins_long_lists_by_pieces(spark, monkeypatch):
    """A case of more findings than a piece holds gives the text that its array gives, with lines that are NULL left out."""
    from caselens.operators import context as cx

    monkeypatch.setattr(cx, "PIECE", 3)
    found = [("A", f"id{i:02d}", "R" if i % 4 else None, f"s{i}", "", i % 5, "x") for i in range(20)] + [("B", "id", None, "s", "t", 1, "x"), (None, "id", "R", "s", "t", 1, "x")]
    findings = spark.createDataFrame(found, "case_id string, correlation_id string, rule string, source string, target string, score int, explanation string")
    events = rows(spark, "A", "a1", 40).unionByName(rows(spark, "C", "c1", 2))
    files = spark.createDataFrame([(c, f"f{i}", f"n{i}", "csv", "parsed", 1, T0) for c, i in (("A", 1), ("A", 2), ("A", 3), ("A", 4), ("B", 1))],
                                  "case_id string, evidence_id string, filename string, file_type string, status string, size_bytes long, created_at timestamp_ntz")
    cases = spark.createDataFrame([("A",), ("B",), ("C",)], "case_id string")
    lines = {"correlations": lambda x: F.concat(x.rule, F.lit(":"), x.source), "evidence_list": lambda x: x.filename, "sessions": lambda x: x.event_count.cast("string")}
    text = {r.case_id: r for r in cx.bundle(events, findings, files, cases, lines=lines).collect()}
    plain = {r.case_id: r for r in cx.bundle(events, findings, files, cases).select(
        "*", *[F.array_join(F.transform(c, f), ",").alias(f"t_{c}") for c, f in lines.items()]).collect()}
    for c in "ABC":
        assert [text[c][k] for k in lines] == [plain[c][f"t_{k}"] for k in lines] and text[c].findings_total == plain[c].findings_total
    assert text["A"].correlations.count(",") == 14 and text["B"].correlations == "" and text["C"].correlations is None and text["A"].findings_total == 20
