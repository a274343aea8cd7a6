"""Neighbourhoods, shortest paths and process chains by repeated joins.

Every level is written to the shared folder, so the plan stays short and a lost
executor costs at most one level. Only row counts reach the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.session import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) pairs in both directions."""
    pairs = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
        F.struct(F.col("dst").alias("u"), F.col("src").alias("v")),
    )).alias("p")).select("p.u", "p.v")
    return pairs.filter("u <> v").distinct()


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` undirected hops of each seed, with the least distance."""
    adj = materialize(undirected(edges), "adjacency")
    frontier = seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node_id")).distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for level in range(1, depth + 1):
        step = (
            frontier.join(adj, frontier["node_id"] == adj["u"]).select("seed", F.col("v").alias("node_id")).distinct()
            .join(seen, ["seed", "node_id"], "left_anti")
        )
        frontier = materialize(step, f"hop{level}")
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(level)))
    return seen.filter("hops > 0")


def _starts(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, root, start): the trees that a source's search needs, and how many hops from it their roots lie.

    A source is one hop from all its neighbours, so their trees serve it as well
    as its own. It takes theirs where they are shared by enough sources: each
    neighbour's tree counts as one over the sources beside it.
    """
    beside = materialize(sources.join(adj, sources["source"] == adj["u"]).select("source", F.col("v").alias("root")), "beside")
    shared = beside.groupBy("root").agg(F.count("*").alias("n"))
    cost = materialize(beside.join(shared, "root").groupBy("source").agg(F.sum(1 / F.col("n")).alias("cost")), "cost")
    near = beside.join(cost.filter("cost < 1"), "source", "left_semi").withColumn("start", F.lit(1))
    return near.unionByName(cost.filter("cost >= 1").select("source", F.col("source").alias("root"), F.lit(0).alias("start")))


# A node with more neighbours than these is never passed over: its neighbours would make too many pairs.
FEW = 32


def _passed(adj: DataFrame) -> DataFrame:
    """(node, near): nodes with few neighbours, no two of them side by side, with all their neighbours.

    A path enters and leaves such a node by two of its neighbours, so a search
    may go from one to the other at once, in two hops. Of two nodes side by side
    the one with fewer neighbours is passed over.
    """
    few = materialize(adj.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") <= FEW), "few")
    ends = adj.join(few.select(F.col("node").alias("u"), F.col("n").alias("_n")), "u").join(
        few.select(F.col("node").alias("v"), F.col("n").alias("_m")), "v", "left")
    below = F.coalesce((F.col("_m") < F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("v") < F.col("u"))), F.lit(False))
    rows = ends.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("near"), F.bool_or(below).alias("_below"))
    return materialize(rows.filter("not _below").drop("_below"), "passed")


def _skips(passed: DataFrame) -> DataFrame:
    """(u, v, over): two nodes with the smallest node passed over between them."""
    pairs = passed.select(F.col("node").alias("over"), F.explode("near").alias("u"), "near").select("over", "u", F.explode("near").alias("v"))
    pairs = pairs.filter("u < v").groupBy("u", "v").agg(F.min("over").alias("over"))
    return pairs.select("over", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*", "over")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Undirected shortest path of each (pair_id, source, target); other columns of the pairs stay.

    Level by level from the source; a node's predecessor is the smallest one.
    Trees are grown once per root and not once per pair: pairs with one source
    share its tree, and sources around a node may share the tree of that node
    (``_starts``). Nodes with few neighbours are passed over (``_passed``): a tree
    holds the others, and the node between two of them is known from the pair.
    A pair leaves the search once its target is found, a tree once
    no open pair needs it. The search goes on until no pair is open or nothing
    new is reached. A pair without a path, or without one of ``max_depth`` hops
    where that is given, has reached = false and no hops.
    """
    return _paths(materialize(undirected(edges), "adjacency"), pairs, max_depth)


def _paths(adj: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    tree, up = ["root", "start"], "struct<via:string,past:string>"
    pairs = materialize(pairs, "pairs")
    passed = _passed(adj)
    asked = pairs.filter("pair_id is not null and source is not null and target is not null").select("source", "target").distinct()
    asked = (
        asked.join(passed.select(F.col("node").alias("source"), F.col("near").alias("_s")), "source", "left")
        .join(passed.select(F.col("node").alias("target"), F.col("near").alias("_t")), "target", "left")
        .withColumn("_k", F.monotonically_increasing_id())
    )
    beside = F.coalesce(F.array_contains("_s", F.col("target")), F.lit(False)) | F.coalesce(F.array_contains("_t", F.col("source")), F.lit(False))
    between = F.array_min(F.array_intersect("_s", "_t"))
    short = F.when(F.col("source") == F.col("target"), F.array("source")).when(beside, F.array("source", "target")).when(
        between.isNotNull(), F.array(F.col("source"), between, F.col("target")))
    asked = materialize(asked.withColumn("path", short), "asked")
    found = asked.filter("path is not null").select("_k", "source", "target", "path", F.lit(0).alias("left"), F.col("source").alias("at"))
    if max_depth is not None:
        found = found.filter(F.size("path") <= max_depth + 1)
    asked = asked.filter("path is null")
    starts = materialize(_starts(adj, asked.select("source").distinct()), "starts")
    needed = materialize(asked.select("_k", "source").join(starts, "source").select("_k", *tree), "searches")
    aims = asked.select("_k", F.explode(F.coalesce("_t", F.array("target"))).alias("node"), F.col("_t").isNotNull().cast("int").alias("more"))
    goals = materialize(needed.join(aims, "_k"), "goals")
    seeds = starts.select(*tree).distinct().select(*tree, F.col("root").alias("node"), F.lit(None).cast(up).alias("up"), F.col("start").alias("hops"))
    whole = adj.join(passed.select(F.col("node").alias("u")), "u", "left_anti").join(passed.select(F.col("node").alias("v")), "v", "left_anti")
    roots = passed.join(starts.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
    links = materialize(whole.select("u", "v").unionByName(roots.select(F.col("node").alias("u"), F.explode("near").alias("v"))), "links")
    skips = materialize(_skips(passed), "skips")
    none = seeds.filter("false")
    last, before, idle, seen, deepest = seeds.filter("start = 0"), none, 0, seeds, 0
    for level in count(1) if max_depth is None else range(1, max_depth + 1):
        open_trees = goals.select(*tree).distinct()
        by_link = last.join(open_trees, tree, "left_semi").join(links, F.col("node") == F.col("u")).select(
            *tree, F.col("v").alias("node"), F.struct(F.col("u").alias("via"), F.lit(None).cast("string").alias("past")).alias("up"))
        by_skip = before.join(open_trees, tree, "left_semi").join(skips, F.col("node") == F.col("u")).select(
            *tree, F.col("v").alias("node"), F.struct(F.col("over").alias("via"), F.col("u").alias("past")).alias("up"))
        step = by_link.unionByName(by_skip).groupBy(*tree, "node").agg(F.min("up").alias("up")).join(
            seen, [*tree, "node"], "left_anti").withColumn("hops", F.lit(level))
        new = materialize(step, f"level{level}")
        last, before = new.unionByName(seeds.filter("start = 1")) if level == 1 else new, last
        idle = idle + 1 if last.isEmpty() else 0
        if idle == 2:
            break
        deepest, seen = level, seen.unionByName(new)
        hit = goals.join(last.select(*tree, "node"), [*tree, "node"]).groupBy("_k", "more").agg(F.min("node").alias("at"))
        hit = materialize(hit if max_depth is None else hit.filter(F.col("more") + level <= max_depth), f"hit{level}")
        if not hit.isEmpty():
            path = F.when(F.col("more") == 1, F.array("at", "target")).otherwise(F.array("at"))
            found = found.unionByName(hit.join(asked, "_k").select("_k", "source", "target", path.alias("path"), F.lit(level).alias("left"), "at"))
            goals = materialize(goals.join(hit.select("_k"), "_k", "left_anti"), f"open{level}")
            if goals.isEmpty():
                break
        if level % 8 == 0:  # a long search keeps a short plan
            seen, found = materialize(seen, "seen"), materialize(found, "reached")
    trail = materialize(found, "found")
    back = seen.withColumnsRenamed({"node": "at", "hops": "left"})
    for _ in range(deepest):
        # of the trees of a pair those count that reach the node in as many hops as the pair does
        ups = trail.filter("left > 1").select("_k", "at", "left").join(needed, "_k").join(back, [*tree, "at", "left"]).groupBy("_k").agg(F.min("up").alias("up"))
        first, past = F.col("left") == 1, F.col("up.past").isNotNull()
        nodes = F.when(first, F.array("source")).when(past, F.array("up.past", "up.via")).otherwise(F.array("up.via"))
        rest = trail.filter("left > 0").join(ups, "_k", "left").select(
            "_k", "source", "target", F.concat(nodes, "path").alias("path"), (F.col("left") - F.size(nodes)).alias("left"), nodes[0].alias("at"))
        trail = materialize(trail.filter("left = 0").unionByName(rest), "trail")
        if trail.filter("left > 0").isEmpty():
            break
    trail = trail.select("source", "target", F.lit(True).alias("_found"), (F.size("path") - 1).alias("hops"), "path")
    known = F.col("_found") & F.col("pair_id").isNotNull()
    return pairs.join(trail, ["source", "target"], "left").select(
        *pairs.columns, *[F.when(known, F.col(c)).alias(c) for c in ("hops", "path")]).withColumn("reached", F.col("hops").isNotNull())


def chains(edges: DataFrame, names: DataFrame, max_depth: int = 4) -> DataFrame:
    """SPAWNED paths of 1..max_depth edges from processes which nothing spawned.

    Parallel edges are kept as a count: ``n_paths`` is the number of paths over
    single edges that use no edge twice.
    """
    spawned = edges.filter(F.col("rel_type") == "SPAWNED").groupBy("case_id", "src", "dst").agg(F.count("*").alias("m"))
    nm = names.select(F.col("node_id"), F.col("name"))
    pairs = materialize(
        spawned.join(nm.select(F.col("node_id").alias("src"), F.col("name").alias("src_name")), "src")
        .join(nm.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name")), "dst"), "spawned")
    roots = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    level = roots.select(
        "case_id", F.array("src", "dst").alias("path"), F.array("src_name", "dst_name").alias("names"),
        F.array(F.concat_ws(">", "src", "dst")).alias("used"), F.col("m").alias("n_paths"), F.col("dst").alias("last"),
    )
    out = level.withColumn("depth", F.lit(1))
    nxt = pairs.select(
        F.col("src").alias("last"), F.col("dst").alias("_to"), F.col("dst_name").alias("_name"), F.col("m").alias("_m"),
        F.concat_ws(">", "src", "dst").alias("_pair"),
    )
    for depth in range(2, max_depth + 1):
        level = (
            level.join(nxt, "last")
            .withColumn("_m", F.col("_m") - F.size(F.filter("used", lambda x: x == F.col("_pair"))))
            .filter("_m > 0")
            .select(
                "case_id", F.concat("path", F.array("_to")).alias("path"), F.concat("names", F.array("_name")).alias("names"),
                F.concat("used", F.array("_pair")).alias("used"), (F.col("n_paths") * F.col("_m")).alias("n_paths"),
                F.col("_to").alias("last"),
            )
        )
        level = materialize(level, f"chain{depth}")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.drop("used", "last")


def chain_counts(edges: DataFrame, names: DataFrame, max_depth: int = 4) -> DataFrame:
    """``chains`` by names alone: (case_id, names, depth, n_paths).

    After every level, paths with the same names, end and used edges become one
    row, so their number is that of name lines and not of paths.
    """
    number = F.sum("m") if "m" in edges.columns else F.count("*")
    spawned = edges.filter(F.col("rel_type") == "SPAWNED").groupBy("case_id", "src", "dst").agg(number.alias("m"))
    nm = names.select("node_id", "name")
    pairs = materialize(
        spawned.join(nm.select(F.col("node_id").alias("src"), F.col("name").alias("src_name")), "src")
        .join(nm.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name")), "dst"), "spawned")
    pair = F.concat_ws(">", "src", "dst")
    roots = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    back = pairs.select(F.col("src").alias("last"), F.col("dst").alias("_to"), F.col("dst_name").alias("_name"), F.col("m").alias("_m"), pair.alias("_pair"))
    level = roots.select("case_id", F.array("src_name", "dst_name").alias("names"), F.array(pair).alias("used"), F.col("dst").alias("last"), F.col("m").alias("n_paths"))
    out = None
    for depth in range(1, max_depth + 1):
        if depth > 1:
            level = level.join(back, "last").withColumn("_m", F.col("_m") - F.size(F.filter("used", lambda x: x == F.col("_pair")))).filter("_m > 0").select(
                "case_id", F.concat("names", F.array("_name")).alias("names"), F.array_sort(F.concat("used", F.array("_pair"))).alias("used"),
                F.col("_to").alias("last"), (F.col("n_paths") * F.col("_m")).alias("n_paths"))
        level = materialize(level.groupBy("case_id", "names", "used", "last").agg(F.sum("n_paths").alias("n_paths")), f"chain{depth}")
        part = level.groupBy("case_id", "names").agg(F.sum("n_paths").alias("n_paths")).withColumn("depth", F.lit(depth))
        out = part if out is None else out.unionByName(part)
    return out


def attack_trace(edges: DataFrame, suspicious: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Paths between suspicious nodes which follow each other in time, per case.

    ``suspicious`` has case_id, node_id and ts. A case where no two of them are
    connected gives its suspicious nodes and their neighbours instead.
    """
    from caselens.operators.ordered import ordered_index

    suspicious, adj = materialize(suspicious, "suspicious"), materialize(undirected(edges), "adjacency")
    ranked = ordered_index(suspicious, ["case_id"], [F.asc_nulls_first("ts"), F.asc("node_id")])
    nxt = ranked.select("case_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("target"))
    pairs = ranked.join(nxt, ["case_id", "pos"]).select(
        F.concat_ws("#", "case_id", F.col("pos").cast("string")).alias("pair_id"), "case_id",
        F.col("node_id").alias("source"), "target",
    )
    paths = _paths(adj, pairs, max_depth).filter("reached")
    on_path = paths.select("case_id", F.explode("path").alias("node_id")).distinct()
    lone = suspicious.select("case_id", "node_id").join(paths.select("case_id").distinct(), "case_id", "left_anti")
    near = lone.join(adj, F.col("node_id") == F.col("u")).select("case_id", F.col("v").alias("node_id"))
    sus = suspicious.select("case_id", "node_id")
    return on_path.unionByName(sus).unionByName(near).distinct()
