"""Prefix trie of conversations that start with turns of another one, from composable fingerprints.

A sequence of turns has the fingerprint (sum of t_i * B^i mod m, length), where
t_i is a hash of turn i. Two fingerprints multiply, (x, n) * (y, k) =
(x + B^n * y, n + k), and a head can be divided off again. So a rebuilt
conversation is written down symbolically: the product of a prefix of its base
and what is left of its own prefix once its own head is divided off. Rebuilt
texts never exist. Three moduli below 2^31 keep all products in longs.

A node is a group of equal fingerprints. Its members name their last turn by a
content reference (the SHA-256 of role and text) and their parent by its
fingerprint; a group with two references or two parents means that two
sequences collide, and all is done again with other bases.

No step gathers a conversation or a node: running sums are cut at partition
ends and joined by a carry; sums over subtrees use that a node's smallest member
stands for it, so they are suffix sums along conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.llm.common import join_counted, shuffle_partitions
from caselens.session import materialize

MODULI = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1597334677, 747796405)
CHUNK = 8192  # ids that are hashed as one piece
WORD_GAPS = r"[\x20\x09-\x0D]+"


def power(base: int, exponent: Column, m: int) -> Column:
    """base ** exponent mod m for exponents of up to 32 bits, by tables of 16 powers."""
    out = None
    for k in range(8):
        table = F.array(*[F.lit(pow(base, e << 4 * k, m)).cast("long") for e in range(16)])
        part = F.get(table, F.shiftright(exponent.cast("long"), 4 * k).bitwiseAND(15).cast("int"))
        out = part if out is None else out * part % m
    return out


def _f(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(len(MODULI))]


NODE = ["depth", *_f("f")]


def running(df: DataFrame, by: str, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0) and makes each of ``sums`` its sum up to and with the row, within ``by`` and in the given order.

    A group may be of any size: rows are dealt out by group and order, summed
    up to the ends of their partition, and what lies before it is added.
    """
    parts = df.repartitionByRange(shuffle_partitions(df), F.col(by), *order).sortWithinPartitions(by, *order)
    parts = materialize(parts.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "running")
    here = Window.partitionBy("_part", by).orderBy("_id")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = parts.groupBy("_part", by).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    carry = total.select("_part", by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inner = parts.withColumn("pos", F.row_number().over(here) - 1).withColumns({c: F.sum(c).over(here) for c in sums})
    joined = inner.join(carry, ["_part", by])
    return joined.withColumn("pos", F.col("pos") + F.col("_n")).withColumns({c: F.col(c) + F.col(f"_s_{c}") for c in sums}).drop("_id", "_part", "_n", *[f"_s_{c}" for c in sums])


def ordered_turns(turns: DataFrame, seed: int) -> DataFrame:
    """(conv_id, pos, ref, words, f*, e*): each turn in place, with the fingerprints of its conversation up to it (f) and before it (e)."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, WORD_GAPS), lambda w: w != "")).cast("long")
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].alias("_turn"), role.alias("_role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("ref"), words.alias("words"),
        *[F.pmod(F.xxhash64(F.lit(seed * 31 + k), role, text), F.lit(m)).alias(f"t{k}") for k, m in enumerate(MODULI)],
    ).filter(F.col("conv_id").isNotNull())
    placed = running(rows, "conv_id", [F.asc_nulls_first("_turn"), F.asc("_role"), F.asc("ref")], [])
    placed = placed.withColumns({f"f{k}": F.col(f"t{k}") * power(BASES[k] + 2 * seed, F.col("pos"), m) % m for k, m in enumerate(MODULI)})
    terms = placed.select("conv_id", F.col("pos").alias("_pos"), "ref", "words", *[F.col(f"f{k}").alias(f"e{k}") for k in range(len(MODULI))], *_f("f"))
    summed = running(terms, "conv_id", [F.asc("_pos")], _f("f"))
    return summed.select("conv_id", "pos", "ref", "words", *[(F.col(f"f{k}") % m).alias(f"f{k}") for k, m in enumerate(MODULI)],
                         *[F.pmod(F.col(f"f{k}") - F.col(f"e{k}"), F.lit(m)).alias(f"e{k}") for k, m in enumerate(MODULI)])


def _members(turns: DataFrame, base: Callable[[Column], Column], take: Callable[[Column], Column], seed: int) -> tuple[DataFrame, DataFrame]:
    """The members of every node: (conv_id, node, parent p*, ref, words); and the node in which each conversation ends."""
    own = materialize(ordered_turns(turns, seed).withColumn("take", take(F.col("conv_id")).cast("long")), "turns")
    skipped = [F.coalesce(F.max(F.when(F.col("pos") == F.col("take") - 1, F.col(f))), F.lit(0)).alias(f"s{f}") for f in _f("f")]
    convs = own.groupBy("conv_id", "take").agg(F.count("*").alias("n"), F.max_by(F.struct(*_f("f")), "pos").alias("whole"), *skipped)
    convs = materialize(convs.withColumn("base", base(F.col("conv_id")).cast("long")), "convs")
    told = convs.agg(F.count("*"), F.max("take"), F.sum("n")).first()
    n_convs, most, n_turns = told[0], told[1] or 0, told[2] or 0

    asked = convs.groupBy("base").agg(F.count("*").alias("_users"))
    heads = own.filter(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "ref", "words", *_f("f"), *_f("e")).join(asked, "base")
    head = join_counted(convs.select("conv_id", "base", "take"), heads, ["base"], "_users", n_convs).filter(F.col("pos") < F.col("take"))
    head = materialize(head.select("conv_id", (F.col("pos") + 1).alias("depth"), *_f("f"), *[F.col(f"e{k}").alias(f"p{k}") for k in range(len(MODULI))], "ref", "words"), "heads")
    taken = head.groupBy("conv_id").agg(F.max("depth").alias("_h"), F.max_by(F.struct(*_f("f")), "depth").alias("_head"))

    def composed(f: str, k: int) -> Column:
        """Fingerprint of the head times what is left of the own prefix ``f``."""
        m = MODULI[k]
        moved = power(pow(BASES[k] + 2 * seed, -1, m), F.col("take") - F.col("h"), m) * F.pmod(F.col(f) - F.col(f"sf{k}"), F.lit(m)) % m
        return (F.col(f"h{k}") + moved) % m

    joint = convs.join(taken, "conv_id", "left").select("*", F.coalesce("_h", F.lit(0)).alias("h"), *[F.coalesce(F.col("_head")[f], F.lit(0)).alias(f"h{k}") for k, f in enumerate(_f("f"))])
    joint = materialize(joint.drop("_h", "_head", "base"), "joint")
    tail = join_counted(own.drop("take").withColumnRenamed("pos", "_pos"), joint, ["conv_id"], "n", n_turns).filter(F.col("_pos") >= F.col("take"))
    tail = tail.select("conv_id", (F.col("_pos") - F.col("take") + F.col("h") + 1).alias("depth"), *[composed(f"f{k}", k).alias(f"f{k}") for k in range(len(MODULI))],
                       *[composed(f"e{k}", k).alias(f"p{k}") for k in range(len(MODULI))], "ref", "words")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), *[zero.alias(f) for f in [*_f("f"), *_f("p")]], F.lit(None).cast("binary").alias("ref"), zero.alias("words"))
    whole = joint.withColumns({f"w{k}": F.col("whole")[f"f{k}"] for k in range(len(MODULI))})
    more = F.col("n") > F.col("take")
    ends = whole.select("conv_id", (F.col("h") + F.greatest(F.col("n") - F.col("take"), F.lit(0))).alias("depth"),
                        *[F.when(more, composed(f"w{k}", k)).otherwise(F.col(f"h{k}")).alias(f"f{k}") for k in range(len(MODULI))])
    return materialize(root.unionByName(head).unionByName(tail), "members"), ends


def ids_hash(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ascending, comma-joined ids of each node; ids are joined to chunks where they lie, and the chunks hashed as a stream."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[int] = []
        rows: list[tuple] = []

        def close() -> None:
            if ids:
                rows.append((*held, ids[0], ",".join(map(str, ids)).encode()))
                ids.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * (len(NODE) + 2)
            out = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:-1]], pa.array(cols[-1], pa.binary())], [*NODE, "first", "ids"])
            rows.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in NODE]
            for node, i in zip(zip(*columns), batch.column("conv_id").to_pylist()):
                if node != held or len(ids) >= CHUNK:
                    close()
                    held = node
                ids.append(i)
            yield flush()
        close()
        yield flush()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * (len(NODE) + 1)
            out = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:-1]], pa.array(cols[-1], pa.string())], [*NODE, "ends_sha256"])
            rows.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in NODE]
            for node, ids in zip(zip(*columns), batch.column("ids").to_pylist()):
                if node == held:
                    state.update(b",")
                else:
                    if held is not None:
                        rows.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256()
                state.update(ids)
            yield flush()
        if held is not None:
            rows.append((*held, state.hexdigest()))
        yield flush()

    fields = ", ".join(f"{c} long" for c in NODE)
    parts = ends.select(*NODE, "conv_id").repartitionByRange(shuffle_partitions(ends), *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = parts.mapInArrow(chunks, f"{fields}, first long, ids binary")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{fields}, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Callable[[Column], Column], take: Callable[[Column], Column], seeds: int = 4) -> DataFrame:
    """The trie of all rebuilt conversations of (conv_id, turn, role, text), a row per node.

    Conversation c is rebuilt as the first ``take(c)`` turns of ``base(c)`` (all
    if it has fewer, none if it is missing), then its own turns after its first
    ``take(c)``. Columns: conv_id (smallest member), depth, parent_conv_id (null
    at the root), n_convs (members), n_children, n_leaves, saved_tokens (words
    of last turns that members of the subtree's nodes share, each counted once
    less than it occurs), ends_sha256 (of the ids of the members that end there).

    Turns are ordered by number, null first, equal ones by role and then by the
    digest of their text; equal rows are turns each. A null role or text is an
    empty one. Rows without conv_id belong to no conversation and are left out.
    An empty table has no trie and gives no rows. Other columns are ignored.
    """
    for seed in range(seeds):
        members, ends = _members(turns, base, take, seed)
        parent = F.struct(*_f("p"))
        nodes = members.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(parent).alias("parent"), F.max(parent).alias("_other"),
            F.min("ref").alias("ref"), F.max("ref").alias("_last"), F.max("words").alias("words"))
        nodes = materialize(nodes, "nodes")
        if nodes.filter((F.col("parent") != F.col("_other")) | (F.col("ref") != F.col("_last"))).isEmpty():
            break
    else:
        raise RuntimeError("fingerprints collide under every seed")

    above = [(F.col("depth") - 1).alias("depth"), *[F.col("parent")[f"p{k}"].alias(f"f{k}") for k in range(len(MODULI))]]
    kids = nodes.filter("depth > 0").select(*above).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.drop("_other", "_last", "ref").join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")

    stands = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    sums = ["saved_tokens", "n_leaves"]
    along = members.select("conv_id", *NODE).join(stands, ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})
    subtree = running(along, "conv_id", [F.desc("depth")], sums).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums])

    named = nodes.filter("n_children > 0").select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    child = nodes.filter("depth > 0").withColumns({"_depth": F.col("depth") - 1, **{f"_f{k}": F.col("parent")[f"p{k}"] for k in range(len(MODULI))}})
    below = join_counted(child, named, [f"_{c}" for c in NODE], "_kids", nodes.count())
    columns = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    every = below.select(*columns).unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = every.join(subtree, NODE).join(ids_hash(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
