"""Graph, traversal and rules on small fixtures."""

import datetime as dt
from collections import deque
from functools import partial

import pytest
from pyspark.sql import functions as F

from caselens.operators import correlate as co
from caselens.operators import graph as gr
from caselens.operators import traverse as tr
from caselens.operators import views as vw
from caselens.schema import conform
from caselens.sources.store import cascade

T0 = dt.datetime(2024, 1, 1)
COLS = ("event_id string, case_id string, evidence_id string, ts timestamp_ntz, source string, hostname string, username string, process_name string, pid long, "
        "parent_process_name string, parent_pid long, command_line string, destination_ip string, destination_port long, is_anomaly boolean, anomaly_score double")


def ev(spark, rows):
    return conform(spark.createDataFrame(rows, COLS))


def row(i, case="c1", evid="v1", source="json", proc="cmd.exe", pid=1, parent=None, ppid=None, ip=None, port=None, user="bob", cmd=None, hot=False, score=0.0):
    return (f"e{i}", case, evid, T0 + dt.timedelta(seconds=i), source, "H", user, proc, pid, parent, ppid, cmd, ip, port, hot, score)


def keyset(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_load_twice_equals_once(spark):
    e = ev(spark, [row(1, parent="winword.exe", ip="8.8.8.8", port=443), row(2, ip="8.8.8.8", port=443, hot=True, score=0.9)])
    n, d = gr.nodes_of(e), gr.edges_of(e)
    assert keyset(gr.upsert_nodes(n, n), "node_id") == keyset(n, "node_id")
    assert keyset(gr.upsert_edges(d, d), "src", "dst", "rel_type") == keyset(d, "src", "dst", "rel_type")
    assert keyset(gr.edges_of(e.unionByName(e)), "src", "dst", "rel_type") == keyset(d, "src", "dst", "rel_type")


def test_no_placeholder_nodes(spark):
    e = ev(spark, [("e1", "c", "v", T0, "pcap", None, None, None, None, None, None, None, "8.8.8.8", 443, False, 0.0)])
    assert {r.label for r in gr.nodes_of(e).collect()} == {"Case", "Evidence", "Event", "IPAddress", "Port"}


def test_real_administrator_keeps_its_node_unless_compat(spark):
    e = ev(spark, [row(1, user="administrator")])
    assert gr.nodes_of(e).filter("label = 'User'").count() == 1
    assert gr.edges_of(e, compat=True).filter("dst_label = 'User'").count() == 0


def test_propagation_reaches_neighbours_only(spark):
    e = ev(spark, [row(1, proc="a.exe"), row(2, proc="b.exe", pid=2, hot=True, score=0.9)])
    flag = {r.name: r.is_anomaly for r in gr.nodes_of(e).filter("label = 'Process'").collect()}
    assert flag == {"a.exe": None, "b.exe": True}


def test_chain_score(spark):
    e = ev(spark, [row(1, proc="powershell.exe", pid=2, parent="winword.exe", ppid=1), row(2, proc="evil.exe", pid=3, parent="powershell.exe", ppid=2)])
    f = co.process_chains(gr.nodes_of(e, "actual"), gr.edges_of(e, "actual")).orderBy(F.desc("score")).collect()
    assert [(r.score, r.severity) for r in f] == [(90, "critical"), (75, "high")]
    # with parent pid 0 the chain breaks
    assert co.process_chains(gr.nodes_of(e), gr.edges_of(e)).count() == 2
    assert tr.chains(gr.edges_of(e), gr.nodes_of(e).filter("label = 'Process'")).agg(F.max("depth")).first()[0] == 1


def brute_chains(edges, max_depth=4):
    """Paths over single edges that use no edge twice."""
    has_in = {d for _s, d in edges}
    out = {}

    def walk(path, used):
        for i, (s, d) in enumerate(edges):
            if s == path[-1] and i not in used:
                p = (*path, d)
                out[p] = out.get(p, 0) + 1
                if len(p) <= max_depth:
                    walk(p, used | {i})

    for root in {s for s, _d in edges} - has_in:
        walk((root,), frozenset())
    return out


@pytest.mark.parametrize("edges", [
    [("r", "a"), ("r", "a"), ("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c")],
    [("r", "a"), ("a", "b"), ("b", "a")], [("r", "x"), ("q", "x"), ("x", "y"), ("x", "y"), ("y", "z"), ("z", "w"), ("w", "v")]])
def test_chains_match_brute_force(spark, edges):
    df = spark.createDataFrame([("c", s, d, "SPAWNED") for s, d in edges], "case_id string, src string, dst string, rel_type string")
    names = spark.createDataFrame([(x, x) for x in {y for e in edges for y in e}], "node_id string, name string")
    got = {tuple(r.path): r.n_paths for r in tr.chains(df, names).collect()}
    assert got == brute_chains(edges)


def bfs(pairs, a, b):
    adj = {}
    for u, v in pairs:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    dist, todo = {a: 0}, deque([a])
    while todo:
        u = todo.popleft()
        for v in adj.get(u, ()):
            if v not in dist:
                dist[v] = dist[u] + 1
                todo.append(v)
    return dist.get(b)


def test_shortest_paths(spark):
    raw = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("p", "q")]
    edges = spark.createDataFrame(raw, "src string, dst string")
    asked = [("1", "a", "d"), ("2", "d", "b"), ("3", "a", "q"), ("4", "c", "c")]
    got = {r.pair_id: r for r in tr.shortest_paths(edges, spark.createDataFrame(asked, "pair_id string, source string, target string")).collect()}
    for pid, s, t in asked:
        want = bfs(raw, s, t)
        if want is None:
            assert not got[pid].reached and got[pid].hops is None
        else:
            assert got[pid].hops == want and got[pid].path[0] == s and got[pid].path[-1] == t and len(got[pid].path) == want + 1


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)], "src string, dst string")
    pairs = spark.createDataFrame([("p", "n00", "n40")], "pair_id string, source string, target string")
    far = tr.shortest_paths(edges, pairs).first()
    assert far.hops == 40 and far.path == [f"n{i:02}" for i in range(41)]
    short = tr.shortest_paths(edges, pairs, 5).first()
    assert not short.reached and short.hops is None and short.path is None


def test_shortest_paths_share_trees(spark):
    """Paths equal those of a search per pair with the smallest predecessor, and sources around one node grow one tree."""
    import random

    from collections import deque

    rnd = random.Random(5)
    links = [(f"p{i:02d}", f"h{rnd.randrange(4)}") for i in range(40) for _ in range(2)] + [("h0", "q0"), ("q0", "h1"), ("h2", "t"), ("t", "z"), ("x", "y")]
    beside = {}
    for a, b in links:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    nodes = sorted(beside)
    asked = [(f"k{i}", rnd.choice(nodes), rnd.choice(nodes)) for i in range(60)] + [("self", "z", "z"), ("lost", "none", "z"), ("null", None, "z")]

    def walk(a, b):
        far, queue = {a: 0}, deque([a])
        while queue:
            n = queue.popleft()
            for m in beside.get(n, ()):
                if m not in far:
                    far[m] = far[n] + 1
                    queue.append(m)
        if b not in far:
            return None
        path = [b]
        while path[0] != a:
            path.insert(0, min(m for m in beside[path[0]] if far[m] == far[path[0]] - 1))
        return path

    edges = spark.createDataFrame(links, "src string, dst string")
    got = {r.pair_id: r for r in tr.shortest_paths(edges, spark.createDataFrame(asked, "pair_id string, source string, target string")).collect()}
    assert {k: r.path for k, r in got.items()} == {k: walk(a, b) for k, a, b in asked}
    assert all(r.hops == (len(r.path) - 1 if r.path else None) and r.reached == (r.path is not None) for r in got.values())
    star = spark.createDataFrame([(f"s{i}", "hub") for i in range(30)], "src string, dst string")
    starts = tr._starts(tr.undirected(star), spark.createDataFrame([(f"s{i}",) for i in range(30)], "source string"))
    assert [tuple(r) for r in starts.select("root", "start").distinct().collect()] == [("hub", 1)]


def test_shortest_paths_pass_over_small_nodes(spark, monkeypatch):
    """Leaves between hubs make no rows of trees, and paths are still those of a search from each source with the smallest predecessor."""
    import random

    from collections import deque

    seen, rnd = written(monkeypatch, tr), random.Random(7)
    monkeypatch.setattr(tr, "FEW", 3)
    links = {(f"leaf{i:02d}", f"h{h}") for i in range(40) for h in rnd.sample(range(6), rnd.randrange(1, 4))} | {("h5", "h6"), ("h6", "x1"), ("x1", "x2"), ("x2", "x3")}
    links |= {(f"far{i}", f"h{7 + i % 2}") for i in range(8)} | {(f"m{i}", f"h{h}") for i in range(3) for h in range(5)} | {("h0", "h1"), ("h3", "x3")}
    beside = {}
    for a, b in links:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    nodes = sorted(beside)
    asked = [(f"k{i}", rnd.choice(nodes), rnd.choice(nodes)) for i in range(150)]

    def walk(a, b):
        far, queue = {a: 0}, deque([a])
        while queue:
            n = queue.popleft()
            for m in beside[n]:
                if m not in far:
                    far[m] = far[n] + 1
                    queue.append(m)
        path = [b] if b in far else None
        while path and path[0] != a:
            path.insert(0, min(m for m in beside[path[0]] if far[m] == far[path[0]] - 1))
        return path

    edges, pairs = spark.createDataFrame(sorted(links), "src string, dst string"), spark.createDataFrame(asked, "pair_id string, source string, target string")
    got = {r.pair_id: r for r in tr.shortest_paths(edges, pairs).collect()}
    assert {k: r.path for k, r in got.items()} == {k: walk(a, b) for k, a, b in asked} and {r.hops for r in got.values()} >= {1, 2, 3, 4, None}
    assert all(r.hops == (len(r.path) - 1 if r.path else None) for r in got.values())
    over = {r.node for r in seen["passed"].collect()}
    assert len(over) >= 40 and all(len(beside[n]) <= 3 and not beside[n] & over for n in over)
    assert {r.node for r in seen["level3"].collect()} & over == set()


def test_attack_trace_case_names(spark):
    edges = spark.createDataFrame([("a", "m"), ("m", "b")], "src string, dst string")
    sus = spark.createDataFrame([("c#1", "a", T0), ("c#1", "b", T0 + dt.timedelta(1))], "case_id string, node_id string, ts timestamp_ntz")
    assert {(r.case_id, r.node_id) for r in tr.attack_trace(edges, sus).collect()} == {("c#1", "a"), ("c#1", "m"), ("c#1", "b")}


def test_attack_trace_fallback(spark):
    edges = spark.createDataFrame([("a", "n"), ("b", "m")], "src string, dst string")
    sus = spark.createDataFrame([("c", "a", T0), ("c", "b", T0 + dt.timedelta(1))], "case_id string, node_id string, ts timestamp_ntz")
    assert {r.node_id for r in tr.attack_trace(edges, sus).collect()} == {"a", "b", "n", "m"}


def test_cross_evidence(spark):
    rows = [row(1, evid="evtx", ip="9.9.9.9", proc="p.exe"), row(2, evid="cap", source="pcap", ip="9.9.9.9", proc=None, pid=None, user=None),
            row(3, evid="cap", source="pcap", ip="7.7.7.7", proc=None, pid=None, user=None)]
    e = ev(spark, rows)
    n, d = gr.nodes_of(e), gr.edges_of(e)
    f = co.cross_evidence(n, d, e).collect()
    assert [(r.score, r.target, r.matches) for r in f] == [(85, "9.9.9.9", 1)]
    assert co.cross_evidence(n, d, e, require_same_ip=False).first().matches == 2


def test_rules_of_ones_own_get_events(spark):
    rows = [row(1, evid="evtx", ip="9.9.9.9", proc="powershell.exe", user="bob"), row(2, evid="cap", source="pcap", ip="9.9.9.9", proc=None, pid=None, user=None),
            row(3, evid="cap", source="pcap", ip="7.7.7.7", proc=None, pid=None, user=None)]
    e = ev(spark, rows)
    found = co.all_findings(gr.nodes_of(e), gr.edges_of(e), e, [partial(co.cross_evidence, require_same_ip=False), co.attack_paths]).collect()
    assert {(r.rule, r.matches) for r in found} == {("CROSS_EVIDENCE_CORRELATION", 2), ("ATTACK_PATH", 1)}
    path = next(r for r in found if r.rule == "ATTACK_PATH")
    assert path.chain[1:] == ["powershell.exe", "9.9.9.9:?"] and "PowerShell or encoded command" in path.reasons


def test_window_of_events_equals_window_of_graph(spark):
    rows = [row(i, proc="certutil.exe" if i == 5 else "cmd.exe", ip="9.9.9.9") for i in range(12)]
    e = ev(spark, rows)
    a = co.temporal_window(gr.nodes_of(e), gr.edges_of(e), "certutil", 1).collect()
    b = co.temporal_window_of_events(e, "certutil", 1).collect()
    assert a and sorted(map(str, a)) == sorted(map(str, b))


def test_hot_address_is_counted_not_listed(spark):
    rows = [row(i, evid="evtx", ip="9.9.9.9", proc="p.exe") for i in range(60)]
    rows += [row(100 + i, evid="cap", source="pcap", ip="9.9.9.9", proc=None, pid=None, user=None) for i in range(70)]
    e = ev(spark, rows)
    out = co.cross_rows(gr.nodes_of(e), gr.edges_of(e), e).collect()
    assert [r.n_pairs for r in out] == [60 * 60 * 70]


def test_view_filters(spark):
    e = ev(spark, [row(1, proc="svchost.exe", ip="8.8.8.8"), row(2, proc="cmd.exe", pid=2, ip="8.8.8.8")])
    n, d = gr.nodes_of(e), gr.edges_of(e)
    assert vw.view(n, d, "network").count() == 2
    assert vw.view(n, d, "network", hide_benign=True).count() == 1
    assert vw.view(n, d, "network", term="CMD").count() == 1
    assert vw.view(n, d, "nonsense").count() == vw.view(n, d, "entity").count()


def test_cascade(spark):
    e = ev(spark, [row(1, evid="v1", proc="a.exe", pid=1), row(2, evid="v2", proc="b.exe", pid=2), row(3, case="c2", evid="v3", proc="a.exe", pid=1)])
    evidence = e.select("case_id", "evidence_id").distinct()
    t = {"events": e, "nodes": gr.nodes_of(e), "edges": gr.edges_of(e)}
    out = cascade(t, evidence.filter("evidence_id in ('v1', 'v3')"), evidence)
    assert {r.event_id for r in out["events"].collect()} == {"e2"}
    names = {r.node_id for r in out["nodes"].collect()}
    assert "process:c1:H:2:b.exe" in names and "process:c1:H:1:a.exe" not in names
    assert not any(x.split(":")[1].startswith("c2") for x in names)


def written(monkeypatch, module):
    """The tables that a module writes, by name."""
    seen, write = {}, module.materialize

    def keep(df, name="step"):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(module, "materialize", keep)
    return seen


def test_a_relation_reads_flat_rows_only(spark):
    e = ev(spark, [row(1, ip="8.8.8.8", port=443), row(2, source="browser")])
    n, d = gr.graph_of(e)
    assert keyset(n, "node_id") == keyset(gr.nodes_of(e), "node_id") and keyset(d, "src", "dst") == keyset(gr.edges_of(e), "src", "dst")
    for df in (d.filter("rel_type = 'CONNECTED_TO'"), n.filter("label = 'IPAddress'")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "Generate" not in plan and "Union" not in plan and plan.count("Relation") <= 1


def test_processes_of_a_name_meet_a_domain_counted(spark):
    nodes = spark.createDataFrame([("c1", f"process:{i}", "Process", "a.exe" if i < 40 else None) for i in range(50)] + [("c1", "domain:d", "Domain", "d"), ("c1", "domain:e", "Domain", "e")],
                                  "case_id string, node_id string, label string, name string")
    edges = spark.createDataFrame([("c1", "RESOLVED", f"process:{i}", "domain:d", 2) for i in range(50)], "case_id string, rel_type string, src string, dst string, m long")
    out = co.domain_resolutions(nodes, edges)
    assert sorted((r.source, r.target, r.matches) for r in out.collect()) == [("Network Service", "d", 20), ("Network Service", "e", 1), ("a.exe", "d", 80)]
    assert out._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].count("Aggregate") >= 2


def test_rules_write_entities_only(spark, monkeypatch):
    seen = written(monkeypatch, co)
    e = ev(spark, [row(1, parent="winword.exe", ip="8.8.8.8", port=443), row(2, ip="8.8.8.8", port=443, evid="v2", source="pcap"), row(3, ip="8.8.8.8")])
    found = co.all_findings(*gr.graph_of(e, "actual"), e)
    assert {r.rule for r in found.collect()} >= {"ATTACK_PATH", "CROSS_EVIDENCE_CORRELATION"}
    assert {r.rel_type for r in seen["counted"].collect()} & {"INVOLVES_PROCESS", "OCCURRED_ON", "CONTAINS_EVENT"} == set()
    assert seen["entities"].filter(F.col("label").isin(gr.EVENT_LABELS)).count() == 0


def test_export_makes_nodes_once(spark, monkeypatch):
    seen = written(monkeypatch, gr)
    n, d = gr.export(*gr.graph_of(ev(spark, [row(1), row(2, hot=True, score=0.9)])))
    assert n is seen["export-nodes"] and d.count() > 0


def test_graph_is_written_by_parts(spark, tmp_path):
    """Every edge stands once in files in gzip, however often the graph is written, and the session's settings stay."""
    from caselens.session import CLEANUP

    e = ev(spark, [row(1, parent="winword.exe", ip="8.8.8.8", port=443), row(2, hot=True, score=0.9), row(2, hot=True, score=0.9), row(3, source="browser")])
    nodes, edges = gr.graph_of(e)
    lone = edges.limit(1).withColumn("rel_type", F.lit(None).cast("string"))
    nodes, edges, before = nodes.filter("label <> 'Host'"), edges.unionByName(lone), spark.conf.get(CLEANUP, None)
    for _ in range(2):
        gr.write_graph(nodes, edges, str(tmp_path))
    n, d = gr.export(nodes, edges)
    assert keyset(spark.read.schema(n.schema).json(f"{tmp_path}/nodes"), "node_id") == keyset(n, "node_id")
    back = spark.read.schema(edges.schema).json(f"{tmp_path}/edges")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, back.select(*gr.EDGE_COLUMNS).collect())) == sorted(map(key, d.collect()))
    kinds = {r.rel_type for r in back.collect()}
    assert kinds >= {None, "CONTAINS_EVENT", "SPAWNED", "USES_PORT", "CONTAINS_VISIT"} and "OCCURRED_ON" not in kinds
    written_files = [f.name for f in tmp_path.glob("*/part-*")]
    assert written_files and all(f.endswith(".json.gz") for f in written_files)
    assert spark.conf.get(CLEANUP, None) == before
