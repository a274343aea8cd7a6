"""Features, the three detectors, and their vote."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.when import hour_or_noon, is_weekend
from caselens.operators.ordered import min_max, quantiles, top_n
from caselens.schema import severity_rank
from caselens.session import materialize

FEATURES = ["hour", "weekend", "subject_freq", "object_freq", "action_freq", "severity_rank"]
MODEL_COUNT = 3
SMALL_CASE = 5
Detector = Callable[[DataFrame], DataFrame]


def features(events: DataFrame) -> DataFrame:
    """Six numbers per event: hour, weekend, three value frequencies in the case, severity.

    Count tables are written before the joins, so the planner knows their size:
    small ones are broadcast and the events are not shuffled for them.
    """
    base = events.select(
        "case_id", "event_id", hour_or_noon(F.col("ts")).alias("hour"), is_weekend(F.col("ts")).alias("weekend"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "object", "action")],
        severity_rank(F.coalesce("severity", F.lit("info"))).alias("severity_rank"),
    )
    sizes = materialize(base.groupBy("case_id").agg(F.count("*").alias("case_size")), "sizes")
    out = base.join(sizes, "case_id")
    for c in ("subject", "object", "action"):
        n = materialize(base.groupBy("case_id", c).agg(F.count("*").alias("_n")), f"{c}-counts")
        out = out.join(n, ["case_id", c]).withColumn(f"{c}_freq", F.col("_n") / F.col("case_size")).drop("_n")
    return out.select("case_id", "event_id", "case_size", *FEATURES)


def small_cases(events: DataFrame) -> DataFrame:
    """Cases with fewer than five events: flag and score by severity and techniques."""
    n = events.groupBy("case_id").agg(F.count("*").alias("_n")).filter(F.col("_n") < SMALL_CASE)
    tagged = F.coalesce(F.size("mitre_techniques") > 0, F.lit(False))
    return events.join(n.drop("_n"), "case_id").select(
        "case_id", "event_id", (F.col("severity").isin("critical", "high", "medium") | tagged).alias("flag"),
        F.when(F.col("severity").isin("critical", "high"), 0.85).otherwise(0.4).alias("score"),
    )


# ---- histogram ---------------------------------------------------------------

def hbos(feats: DataFrame, bins: int = 10, contamination: float | None = None) -> DataFrame:
    """Histogram-based outlier score per case.

    Events fall into at most bins^6 cells per case; only cells are scored.
    """
    ends = feats.groupBy("case_id").agg(
        F.count("*").alias("_n"), *[F.min(f).alias(f"_mn_{f}") for f in FEATURES], *[F.max(f).alias(f"_mx_{f}") for f in FEATURES])
    rows = feats.join(materialize(ends, "ends"), "case_id")

    def width(f: str) -> Column:
        mn, mx = F.col(f"_mn_{f}"), F.col(f"_mx_{f}")
        return F.when(mx > mn, (mx - mn) / bins).otherwise(1.0 / bins)

    def bin_of(f: str) -> Column:
        mn, mx = F.col(f"_mn_{f}"), F.col(f"_mx_{f}")
        return F.when(mx > mn, F.least(F.floor((F.col(f) - mn) / width(f)), F.lit(bins - 1))).otherwise(bins // 2).cast("int")

    cells = [f"_b_{f}" for f in FEATURES]
    binned = rows.select("case_id", "event_id", *[bin_of(f).alias(f"_b_{f}") for f in FEATURES])
    counts = rows.select("case_id", "_n", *[width(f).alias(f"_w_{f}") for f in FEATURES], *[bin_of(f).alias(f"_b_{f}") for f in FEATURES]).groupBy(
        "case_id", "_n", *[f"_w_{f}" for f in FEATURES], *cells).agg(F.count("*").alias("_c"))
    long = counts.select("case_id", "_n", "_c", F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(f"_b_{f}").alias("b"), F.col(f"_w_{f}").alias("w")) for i, f in enumerate(FEATURES)])).alias("x"))
    heights = long.groupBy("case_id", "_n", "x.f", "x.b", "x.w").agg(F.sum("_c").alias("c")).select(
        "case_id", F.concat_ws(":", F.col("f").cast("string"), F.col("b").cast("string")).alias("k"),
        F.log2(F.col("c") / (F.col("_n") * F.col("w")) + 0.1).alias("v"))
    lookup = heights.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_h"))  # 60 entries
    total: Column = F.lit(0.0)
    for i, _f in enumerate(FEATURES):
        total = total + F.element_at("_h", F.concat(F.lit(f"{i}:"), F.col(cells[i]).cast("string")))
    scored = counts.select("case_id", *cells).join(lookup, "case_id").withColumn("raw", F.round(-total, 9)).drop("_h")
    scored = materialize(scored, "cells")
    rows = materialize(binned.join(scored, ["case_id", *cells]).select("case_id", "event_id", "raw"), "hbos")
    share = F.lit(contamination) if contamination is not None else F.when(F.col("n") >= 20, 0.05).otherwise(0.1)
    cut = quantiles(rows, ["case_id"], "raw", 1 - share)
    out = min_max(rows, ["case_id"], "raw", "score").join(cut.select("case_id", "quantile"), "case_id")
    return out.select("case_id", "event_id", F.lit("hbos").alias("model"), (F.col("raw") >= F.col("quantile")).alias("flag"), "score")


# ---- local outlier factor --------------------------------------------------------

# down to the steps of frequencies in cases of millions of events: a coarser first grid would pair whole cases
WIDTHS = [*(4.0 ** -i for i in range(12, 0, -1)), 1.0, 4.0, 64.0]
ROUNDING = 1e-9  # distances are rounded to nine digits


def _cell(x: list[Column], w: float) -> list[tuple[Column, bool]]:
    """Grid cell of a vector at width w, and for each part whether neighbouring cells must be searched.

    Hour and weekend are whole numbers and severity has steps of 0.25, so below
    that step only equal values can be within w. Frequencies lie in 0..1.
    """
    zero = F.lit(0).cast("bigint")

    def part(c: Column, step: float) -> Column:
        return F.floor(c / step).cast("bigint")

    return [
        (part(x[0], max(w, 1.0)), w >= 1), (part(x[2], w) if w <= 1 else zero, w <= 1), (part(x[3], w) if w <= 1 else zero, w <= 1),
        (part(x[1], 1.0) if w < 1 else zero, False), (part(x[5], 0.25) if w < 0.25 else zero, False),
    ]


def _first_width(vecs: DataFrame, grid: list[Column], busy_cell: int) -> int:
    """Place of the widest width whose cells hold at most ``busy_cell`` vectors; only one number per width comes back."""
    busiest = vecs.select("case_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.array(*[c for c, _n in _cell(grid, w)]).alias("c")) for i, w in enumerate(WIDTHS)])).alias("g")).groupBy(
        "case_id", "g.i", "g.c").agg(F.count("*").alias("n")).groupBy("i").agg(F.max("n").alias("n")).collect()
    return max((r["i"] for r in busiest if r["n"] <= busy_cell), default=0)


def lof(feats: DataFrame, k: int = 10, contamination: float = 0.05, busy_cell: int = 64) -> DataFrame:
    """Local outlier factor per case, exact, without comparing all pairs.

    Equal vectors are merged with their count. Neighbours come from a grid: a
    vector looks at the cells around its own and is done once k neighbours lie
    within one cell width (nothing outside can be nearer); the others go on
    with cells four times as wide. The first width is the widest whose cells
    hold at most ``busy_cell`` vectors. All neighbours at the k-distance count.
    """
    xs = [f"x{i}" for i in range(len(FEATURES))]
    spread = feats.groupBy("case_id").agg(F.count("*").alias("_n"), *[F.var_pop(f).alias(f"_v{i}") for i, f in enumerate(FEATURES)])
    rows = feats.join(spread, "case_id").select("case_id", "event_id", "_n", *[
        F.when(F.col(f"_v{i}") > 1e-10, F.col(f)).otherwise(0.0).alias(xs[i]) for i, f in enumerate(FEATURES)])
    rows = rows.withColumn("vid", F.unhex(F.md5(F.concat_ws("|", "case_id", *xs))))
    uniq = rows.groupBy("case_id", "vid", "_n", *xs).agg(F.count("*").alias("w"))
    kk = uniq.groupBy("case_id").agg(F.least(F.lit(k), F.count("*") - 1, F.any_value("_n") - 1).alias("k"))
    vecs = materialize(uniq.join(kk.filter("k >= 2"), "case_id").drop("_n"), "vectors")
    grid = [F.col(x) for x in xs]

    start = _first_width(vecs, grid, busy_cell)

    active, found = vecs, None
    for w in WIDTHS[start:]:
        last = w == WIDTHS[-1]
        offsets = F.array(*[F.lit(o).cast("bigint") for o in (-1, 0, 1)])
        cell = _cell(grid, w)
        g = [c.alias(f"g{i}") for i, (c, _n) in enumerate(cell)]
        probe = active.select("case_id", "vid", "k", *[F.col(x).alias("a_" + x) for x in xs], *g)
        for i, (_c, search) in enumerate(cell):
            if search:
                probe = probe.withColumn("_o", F.explode(offsets)).withColumn(f"g{i}", F.col(f"g{i}") + F.col("_o")).drop("_o")
        base = vecs.select("case_id", F.col("vid").alias("nb"), F.col("w").alias("nw"), *xs, *g)
        sq: Column = F.lit(0.0)
        for x in xs:
            sq = sq + (F.col("a_" + x) - F.col(x)) * (F.col("a_" + x) - F.col(x))
        pairs = probe.join(base, ["case_id", *[f"g{i}" for i in range(len(cell))]]).select(
            "vid", "k", "nb", F.when(F.col("vid") == F.col("nb"), F.col("nw") - 1).otherwise(F.col("nw")).alias("nw"), F.round(F.sqrt(sq), 9).alias("d"))
        if not last:
            pairs = pairs.filter(F.col("d") <= w - ROUNDING)  # what rounds to no more lies in the cells searched
        cum = Window.partitionBy("vid").orderBy("d")
        # the k-distance neighbours have rank <= k; map tasks drop the rest before the shuffle
        close = pairs.filter("nw > 0").withColumn("_r", F.rank().over(cum)).filter(F.col("_r") <= k)
        near = close.withColumn("_cum", F.sum("nw").over(cum)).withColumn(
            "kd", F.min(F.when(F.col("_cum") >= F.col("k"), F.col("d"))).over(Window.partitionBy("vid")))
        near = materialize(near.filter("d <= kd").select("vid", "nb", "nw", "d", "kd"), "knn")
        found = near if found is None else found.unionByName(near)
        active = active.join(near.select("vid").distinct(), "vid", "left_anti")
        if not last:
            active = materialize(active, "open")
            if active.isEmpty():
                break
    kd = found.select(F.col("vid").alias("nb"), F.col("kd").alias("nkd")).distinct()
    lrd = found.join(kd, "nb").groupBy("vid").agg(
        (1.0 / (F.sum(F.col("nw") * F.greatest("nkd", "d")) / F.sum("nw") + 1e-10)).alias("lrd"))
    lrd = materialize(lrd, "lrd")
    nb_lrd = lrd.select(F.col("vid").alias("nb"), F.col("lrd").alias("nlrd"))
    factor = found.join(nb_lrd, "nb").groupBy("vid").agg((F.sum(F.col("nw") * F.col("nlrd")) / F.sum("nw")).alias("m")).join(
        lrd, "vid").select("vid", F.round(F.col("m") / F.col("lrd"), 6).alias("raw"))
    scored = rows.select("case_id", "event_id", "vid").join(factor, "vid", "left").select("case_id", "event_id", "raw")
    scored = materialize(scored, "lof")
    cut = quantiles(scored.filter("raw is not null"), ["case_id"], "raw", F.lit(1 - contamination)).select("case_id", "quantile")
    out = min_max(scored, ["case_id"], "raw", "score").join(cut, "case_id", "left")
    return out.select(
        "case_id", "event_id", F.lit("lof").alias("model"), F.coalesce(F.col("raw") > F.col("quantile"), F.lit(False)).alias("flag"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


# ---- isolation forest --------------------------------------------------------------

TREES, TREE_ROWS, SHARE = 50, 256, 0.05
PRIME, FACTOR = 2147483647, 48271  # h * FACTOR^(tree + 1) + tree modulo PRIME: a row's place in the order of a tree's draw


def tree_factors(trees: int) -> list[int]:
    return [pow(FACTOR, t + 1, PRIME) for t in range(trees)]


def _hex(digest: Column, start: int) -> Column:
    """Eight hex digits of a digest as a number."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2.0 * (F.log(n - 1.0) + float(np.euler_gamma)) - 2.0 * (n - 1.0) / n)


def forest_sample(feats: DataFrame, trees: int = TREES, sample: int = TREE_ROWS) -> DataFrame:
    """For each tree its own sample: the min(sample, n) rows that come first in the tree's order of hashes, then of ids.

    A row is copied only to the trees where it is among about the first twice
    the sample, so the copies do not grow with the table.
    """
    rows = feats.select("event_id", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"))
    n = rows.count()
    factors = F.array(*[F.lit(f).cast("bigint") for f in tree_factors(trees)])
    rows = rows.withColumn("_v", _hex(F.md5("event_id"), 1) % PRIME)
    hashed = lambda t: (F.col("_v") * F.get(factors, t) + t) % PRIME
    near = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) * F.lit(float(n)) <= F.lit(2.0 * (sample + 64) * PRIME))
    dealt = rows.select("*", F.explode(near).alias("tree_id")).withColumn("_h", hashed(F.col("tree_id")))
    return top_n(dealt, ["tree_id"], [F.asc("_h"), F.asc("event_id")], sample).select("tree_id", "event_id", "x")


def fit_forest(baseline: DataFrame, trees: int = TREES, sample: int = TREE_ROWS) -> DataFrame:
    """Isolation trees as a table of nodes, fitted on the features of a baseline.

    All trees grow one level at a time: each row knows its node, and the node's
    ends per feature give its cut. Feature and cut are drawn from the md5 of
    tree and node, so a forest follows from its rows alone. Node 1 is the root,
    the children of node i are 2i and 2i + 1. Columns: tree_id, node_id, feature
    (-1 at leaves), threshold, path (leaves: depth and what is left of a path),
    node_rows, n_rows (of the tree). The sample is bounded; trees are dealt out whole.
    """
    rows = forest_sample(baseline, trees, sample).repartition("tree_id")
    rows = rows.withColumns({"size": F.count("*").over(Window.partitionBy("tree_id")), "node": F.lit(1).cast("bigint"), "done": F.lit(False), "nodes": F.array().cast(
        "array<struct<node_id:bigint,feature:int,threshold:double,path:double,node_rows:bigint,n_rows:bigint>>")})
    levels = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    for depth in range(levels + 1):
        here = Window.partitionBy("tree_id", "node")
        ends = [F.array(*[fn(F.get("x", i)).over(here) for i in range(len(FEATURES))]) for fn in (F.min, F.max)]
        rows = rows.withColumns({"n": F.count("*").over(here), "lo": ends[0], "hi": ends[1], "_d": F.md5(F.concat_ws(":", F.col("tree_id").cast("string"), F.col("node").cast("string")))})
        rows = rows.withColumn("_open", F.filter(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), lambda i: F.get("hi", i) > F.get("lo", i)))
        leaf = (F.lit(depth) >= F.ceil(F.log2(F.greatest("size", F.lit(2))))) | (F.col("n") <= 1) | (F.size("_open") == 0)
        rows = rows.withColumn("_f", F.when(leaf, -1).otherwise(F.get("_open", (_hex(F.col("_d"), 1) % F.size("_open")).cast("int"))))
        lo, hi = F.get("lo", F.col("_f")), F.get("hi", F.col("_f"))
        rows = rows.withColumn("_cut", F.when(leaf, 0.0).otherwise(lo + _hex(F.col("_d"), 9) / F.lit(4294967296.0) * (hi - lo)))
        node = F.struct(F.col("node").alias("node_id"), F.col("_f").alias("feature"), F.col("_cut").alias("threshold"), F.when(leaf, depth + average_path(F.col("n"))).otherwise(0.0).alias("path"), F.col("n").alias("node_rows"), F.col("size").alias("n_rows"))
        rows = rows.withColumns({
            "nodes": F.when(F.col("done"), F.col("nodes")).otherwise(F.array_append("nodes", node)), "done": F.col("done") | leaf,
            "node": F.when(F.col("done") | leaf, F.col("node")).otherwise(2 * F.col("node") + (F.get("x", F.col("_f")) > F.col("_cut")).cast("bigint"))})
        rows = rows.select("tree_id", "event_id", "x", "size", "node", "done", "nodes")
    return rows.select("tree_id", F.explode("nodes").alias("n")).select("tree_id", "n.*").dropDuplicates(["tree_id", "node_id"])


def _isolation(feats: DataFrame, forest: DataFrame) -> DataFrame:
    """Anomaly value 2^(-mean path / c) of each row, c for the rows the trees saw. The forest is of fixed size.

    Paths are summed as whole billionths, so the value does not depend on an order.
    """
    table = forest.toPandas()
    packed = []
    for _t, g in table.groupby("tree_id"):
        at = g["node_id"].to_numpy()
        feat, cut, path = np.full(at.max() + 1, -1, np.int64), np.zeros(at.max() + 1), np.zeros(at.max() + 1, np.int64)
        feat[at], cut[at], path[at] = g["feature"], g["threshold"], np.round(g["path"].to_numpy() * 1e9)
        packed.append((feat, cut, path))
    seen = table.loc[table["node_id"] == 1, "n_rows"].to_numpy(float)
    each = [0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n for n in seen]
    scale = max(float(np.mean(each)) if each else 0.0, 1e-9)

    def score(batches):
        for pdf in batches:
            x = pdf[FEATURES].to_numpy(float)
            depth = np.zeros(len(x), np.int64)
            for feat, cut, path in packed:
                at = np.ones(len(x), np.int64)
                inner = feat[at] >= 0
                while inner.any():
                    i = np.flatnonzero(inner)
                    f = feat[at[i]]
                    at[i] = 2 * at[i] + (x[i, f] > cut[at[i]])
                    inner[i] = feat[at[i]] >= 0
                depth += path[at]
            raw = np.round(2.0 ** (-(depth / 1e9) / max(len(packed), 1) / scale), 9)
            yield pd.DataFrame({"case_id": pdf["case_id"].astype(object), "event_id": pdf["event_id"].astype(object), "raw": raw})

    return feats.select("case_id", "event_id", *FEATURES).mapInPandas(score, "case_id string, event_id string, raw double")


def isolation_forest(
    feats: DataFrame, forest: DataFrame, baseline: DataFrame, sample: int = TREE_ROWS, trees: int = TREES, contamination: float = SHARE,
) -> DataFrame:
    """Score with a fitted forest; flag beyond the baseline's threshold; min-max per case."""
    drawn = forest_sample(baseline, trees, sample).select(F.lit("baseline").alias("case_id"), "event_id", *[F.get("x", i).alias(f) for i, f in enumerate(FEATURES)])
    limit = _isolation(drawn, forest).agg(F.round(F.percentile("raw", F.lit(1 - contamination)), 9)).first()[0]  # bounded sample
    rows = materialize(_isolation(feats, forest), "forest")
    out = min_max(rows, ["case_id"], "raw", "score")
    flag = F.coalesce(F.col("raw") > F.lit(limit).cast("double"), F.lit(False))
    return out.select("case_id", "event_id", F.lit("isolation_forest").alias("model"), flag.alias("flag"), "score")


# ---- ensemble ------------------------------------------------------------------------

def vote(results: DataFrame, models: int = MODEL_COUNT) -> DataFrame:
    """Flag with two votes or more; mean score over all models, a missing one counting 0."""
    return results.groupBy("case_id", "event_id").agg(
        (F.count_if("flag") >= 2).alias("flag"), (F.sum("score") / models).alias("score"))


def detect(events: DataFrame, baseline: DataFrame | None = None, detectors: list[Detector] | None = None) -> DataFrame:
    """Scores of all events: rule-based for small cases, the ensemble otherwise."""
    feats = materialize(features(events), "features")
    big = feats.filter(F.col("case_size") >= SMALL_CASE)
    if detectors is None:
        base = feats if baseline is None else baseline  # without a baseline the events are their own
        forest = materialize(fit_forest(base), "trees")
        detectors = [lambda f: isolation_forest(f, forest, base), hbos, lof]
    parts = [d(big) for d in detectors]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return vote(out, len(detectors)).unionByName(small_cases(events))
