"""Mixing sources to target weights by balanced sampling (the cube method).

A source is to be taken ``target / size`` times. The whole part of that rate is
copies of every document; the rest is an inclusion probability. The flight phase
moves probabilities along the null-space of the balance (words, documents) until
one of them is 0 or 1, so both totals stay put; about two are left at the end.
Parts of a source fly alone, what they leave flies together, and the last two of
a source are landed by giving up first the documents, then the words. The last
few steps of a source are tried several times, and the try nearest to its words
is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.session import materialize

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
PART = 2048
SPREAD = 1024
NEAR = 1e-9
LANDING, TRIES = 16, 64


def words_of(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target), from one row per source (source, source_size, n_docs).

    Sources in code point order, null last, weigh as ``weights`` repeats. They
    share ``share`` times all words; a source stops at ``cap`` times its own, and
    the excess goes to the others by weight: sources are filled in the order of
    cap per weight, so the level is found by running sums.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_top", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_top") / F.col("_w"), F.asc_nulls_last("source"))
    whole = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_top").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    rows = rows.withColumn("_level", level)
    # the first source in that order which its share does not fill sets the level
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_top"), F.col("_level"))
    found = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_found", found).select("source", "source_size", "n_docs", F.least("_top", F.coalesce(F.col("_w") * F.col("_found"), F.col("_top"))).alias("target"))


def fly(sizes: np.ndarray, probs: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for two or so; with ``land`` all of them.

    To land, the flight stops at ``LANDING`` open units. That small problem is
    flown to its end ``TRIES`` times, and the end nearest in words is kept.
    """
    size, p = np.asarray(sizes, float), np.array(probs, float)
    if not land:
        return _fly(size, p, rng, 2, False)
    p = _fly(size, p, rng, LANDING, False)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        goal = (size[open_] * p[open_]).sum()
        ends = [_fly(size[open_], p[open_], rng, 2, True) for _ in range(TRIES)]
        p[open_] = min(ends, key=lambda x: abs((x * size[open_]).sum() - goal))
    return p


def _fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, least: int, land: bool) -> np.ndarray:
    """Each step decides about the largest open unit: its change is made up for by
    small changes of all others, spread so that words and documents stay put,
    and goes on until some unit is at 0 or 1. So what is left is small.
    """
    p = p.copy()
    order = np.argsort(-size, kind="stable")
    now = order[(p[order] > 0) & (p[order] < 1)]
    stuck: list[int] = []

    def move(at: np.ndarray, along: np.ndarray) -> None:
        room = np.where(along > 0, 1 - p[at], p[at]), np.where(along > 0, p[at], 1 - p[at])
        pace = np.abs(along)
        moving = pace > 0
        up, down = (float((r[moving] / pace[moving]).min()) for r in room)
        x = p[at] + (up if rng.random() * (up + down) < down else -down) * along
        p[at] = np.where(x < NEAR, 0.0, np.where(x > 1 - NEAR, 1.0, x))

    while len(now) > least:
        rest = now[1:]
        slack = np.minimum(p[rest], 1 - p[rest])
        mean = (slack * size[rest]).sum() / slack.sum()
        off, gap = size[rest] - mean, mean - size[now[0]]
        spread = (slack * off * off).sum()
        if spread <= NEAR * mean * mean * slack.sum() and abs(gap) > NEAR * max(mean, 1.0):  # the others are all alike: they cannot make up for it
            stuck.append(int(now[0]))
            now = rest
            continue
        tilt = gap / spread if abs(gap) > NEAR * max(mean, 1.0) else 0.0
        move(now, np.concatenate([[1.0], slack * (tilt * off - 1 / slack.sum())]))
        now = now[(p[now] > 0) & (p[now] < 1)]
    left = [*stuck, *now.tolist()]
    while land and len(left) > 1:  # documents given up: words alone
        a, b = size[left[0]], size[left[1]]
        top = max(a, b)
        move(np.array(left[:2]), np.array([b / top, -a / top] if top else [1.0, -1.0]))
        left = [i for i in left if 0 < p[i] < 1]
    if land and left:
        p[left[0]] = float(rng.random() < p[left[0]])
    return p


def inclusion(units: DataFrame, seed: int = 7, part: int = PART) -> DataFrame:
    """(row, take 0 or 1) of units (row, source, doc_id, size, p, n_docs), p one value per source.

    Which units fly together and every draw come from ids and ``seed`` alone.
    """
    def flight(last: bool):
        def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            df = df.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], na_position="last", kind="stable")
            word = hashlib.sha256(repr((seed, last, key[0] if isinstance(key[0], str) else None, int(key[1]))).encode()).digest()
            df["p"] = fly(df["size"].to_numpy(), df["p"].to_numpy(), np.random.default_rng(int.from_bytes(word[:8], "little")), last)
            return df[names]

        return run

    names = ["row", "source", "doc_id", "size", "p", "part", "parts"]
    kinds = "row long, source string, doc_id long, size long, p double, part long, parts long"
    parts = F.ceil(F.col("n_docs") / part).cast("long")
    now = units.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).select(*names)
    done = []
    while True:
        last = (now.agg(F.max("parts").alias("m")).first()["m"] or 1) == 1
        flown = materialize(now.groupBy("source", "part").applyInPandas(flight(last), kinds), "flight")
        done.append(flown.filter("p in (0, 1)").select("row", F.col("p").cast("int").alias("take")))
        if last:
            break
        now = flown.filter("p not in (0, 1)").withColumn("part", F.floor(F.col("part") / SPREAD)).withColumn("parts", F.ceil(F.col("parts") / SPREAD))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mixed(rows: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows (row, doc_id, source, size), row unique: adds source_size, target and copies.

    A source without words has target and copies 0. Rows without source form the
    last source. Equal ids are rows of their own. Without rows there is no result.
    """
    plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, cap), "targets")
    to = plan.withColumnRenamed("source", "_s")
    joined = rows.join(to, rows["source"].eqNullSafe(to["_s"])).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < NEAR, F.round(rate)).otherwise(rate)
    planned = materialize(joined.withColumn("_base", F.floor(rate)).withColumn("p", rate - F.floor(rate)), "planned")
    some = inclusion(planned.filter("p > 0"), seed)
    return planned.join(some, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", (F.col("_base") + F.coalesce("take", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as it is taken."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    sized = rows.select(F.col("__row").alias("row"), rows[id_col].cast("long").alias("doc_id"), rows[source_col].cast("string").alias("source"), words_of(rows[text_col]).alias("size"))
    taken = mixed(materialize(sized, "sizes"), seed, **how).filter("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))
    return rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)
