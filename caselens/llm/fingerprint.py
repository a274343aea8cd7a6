"""SimHash document fingerprints with DataFrame functions only, and a search by permuted block tables.

A term is a run without white space, lower-cased; its weight grows with its
length, so that short words common to a language count little. Every occurrence
votes with its weight for the bits of the term's hash and against the others. Two
bits share one sum (each in half a long), so a document needs 32 sums.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.llm.common import bits_hex, texts
from caselens.operators.ordered import ordered_index
from caselens.session import materialize

PAIR = 0x0000000100000001
RADIUS, BLOCKS = 3, 5
MIN_BITS, MAX_GROUPS = 7, 1 << 20


def weight(term: Column) -> Column:
    """0 for an empty string, 1 for up to three letters, then 3 more for each letter, 16 at most."""
    n = F.length(term)
    return F.when(n == 0, 0).otherwise(F.least(F.greatest(3 * n - 8, F.lit(1)), F.lit(16))).cast("long")


def votes(hash_col: str, weight_col: str) -> list[Column]:
    """32 sums, the votes for bit b in the low half and for bit b + 32 in the high half, and all weights.

    A half holds 2^32 votes: more than the weights of the longest string a cell can hold.
    """
    both = lambda b: F.shiftrightunsigned(hash_col, b).bitwiseAND(F.lit(PAIR)) * F.col(weight_col)
    return [F.sum(both(b)).alias(f"_v{b}") for b in range(32)] + [F.sum(weight_col).alias("_all")]


def bits() -> Column:
    """The fingerprint: bit set where the votes for it exceed half of all weights."""
    out = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"_v{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{b}", 32)
        out = out.bitwiseOR(F.when(2 * low > F.col("_all"), F.lit(1 << b)).otherwise(F.lit(0).cast("long")))
        out = out.bitwiseOR(F.when(2 * high > F.col("_all"), F.lit((1 << (b + 32)) - (1 << 64) * (b == 31))).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """(key, *keep, fp) of rows with a unique long ``key`` and other long columns: zero for a text without terms."""
    terms = rows.select(key, *keep, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")).alias("_t"))
    hashed = terms.select(key, *keep, F.xxhash64("_t").alias("_h"), weight(F.col("_t")).alias("_w"))
    summed = hashed.groupBy(key).agg(*[F.max(c).alias(c) for c in keep], *votes("_h", "_w"))
    return summed.select(key, *keep, bits().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the differing bits stand for, 0 where it is negative."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)))


def masks(radius: int, blocks: int) -> list[int]:
    """One mask per table: with ``radius`` differing bits at least blocks - radius blocks agree, so some table has them all."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than the radius are needed")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def within(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_fp, fp): all distinct stored fingerprints within ``radius`` bits of the distinct queried ones (column fp of both).

    Each table permutes its blocks to the front, which here is a mask and a table
    number as join key; a pair that several tables find is one row.
    """
    signed = [m - (1 << 64) * (m >> 63) for m in masks(radius, blocks)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
        return df.select("fp").filter("fp is not null").distinct().select(F.col("fp").alias(name), F.explode(tables).alias("b")).select(name, "b.t", "b.k")

    near = F.bit_count(F.col("_q").bitwiseXOR(F.col("_s"))) <= radius
    q, s = keyed(queries, "_q"), keyed(stored, "_s")
    found = q.join(s, (q["t"] == s["t"]) & (q["k"] == s["k"]) & near)
    return found.select(F.col("_q").alias("query_fp"), F.col("_s").alias("fp")).distinct()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, hash, next_id, next_text, next_hash) in descending order of ids, the last followed by the first.

    Rows without id come last, equal ids in the order of their text's hash. Ids are
    grouped by their upper bits, so the texts are moved once; the first document
    of each group is also sent to the group above it, where it ends the order.
    """
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"))
    n = ids.count()
    low = max(MIN_BITS, (n // MAX_GROUPS).bit_length())  # so that dense ids make at most MAX_GROUPS groups
    group = F.coalesce(F.shiftright("doc_id", low), F.lit(-(1 << 62)))
    tops = ids.groupBy(group.alias("g")).agg(F.max("doc_id").alias("_top"))
    placed = ordered_index(materialize(tops, "tops"), [], [F.asc("g")])
    placed = materialize(placed.select("g", "_top", "pos"), "places")
    rows = texts(docs, id_col, text_col).withColumn("g", group).withColumn("hash", F.xxhash64("text"))
    first = rows.join(placed.withColumnRenamed("g", "_g"), F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("g") == F.col("_g")))
    # a group whose top id occurs many times keeps one of them, that of the highest hash, as the order below does
    chosen = first.groupBy("pos").agg(F.max("hash").alias("hash"))
    first = materialize(first.join(chosen, ["pos", "hash"]).select("pos", "doc_id", "text", "hash").dropDuplicates(["pos"]), "firsts")
    count = placed.agg(F.max("pos").alias("n")).first()["n"] or 0
    above = F.when(F.col("pos") == count, 1).otherwise(F.col("pos") + 1)
    ends = first.select(above.alias("pos"), "doc_id", "text", "hash").join(placed.select("pos", "g"), "pos").select("doc_id", "text", "g", "hash", F.lit(1).alias("_end"))
    order = Window.partitionBy("g").orderBy("_end", F.desc_nulls_last("doc_id"), F.desc("hash"))
    lead = {f"next_{c}": F.lead(c).over(order) for c in ("text", "hash")} | {"next_id": F.lead("doc_id").over(order)}
    return rows.withColumn("_end", F.lit(0)).unionByName(ends).withColumns(lead).filter("_end = 0").select("doc_id", "text", "hash", "next_id", "next_text", "next_hash")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has its last third (rounded down) replaced by as many first
    characters of the next document. A null text is empty; every row has its
    result, repeated rows too; an empty table gives none.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    pairs = with_next(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "hash", "next_id", "next_hash", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    sha = F.sha2("edited", 256)
    long = lambda i: F.conv(F.substring(sha, 15 * i + 1, 15), 16, 10).cast("long").alias(f"_s{i}")  # noqa: E731  60 bits each
    rows = pairs.select(
        "_row", "doc_id", "hash", "next_id", "next_hash", "n_chars", *[long(i) for i in range(5)],
        F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("t")))).alias("x"))
    keep = ["doc_id", "hash", "next_id", "next_hash", "n_chars", *[f"_s{i}" for i in range(5)]]
    both = fingerprints(rows.select((F.col("_row") * 2 + F.col("x.k")).alias("_key"), *keep, F.col("x.t").alias("t")), "_key", "t", keep)
    both = materialize(both, "voted")
    sha_back = F.lower(F.concat(*[F.lpad(F.hex(f"_s{i}"), 15 if i < 4 else 4, "0") for i in range(5)]))
    own = both.filter("_key % 2 = 0")
    other = both.filter("_key % 2 = 1").select((F.col("_key") - 1).alias("_key"), F.col("fp").alias("edited_fp"))
    after = own.select(F.col("doc_id").alias("_n"), F.col("hash").alias("_nh"), F.col("fp").alias("next_fp")).distinct()
    paired = own.join(other, "_key").join(after, F.col("next_id").eqNullSafe(F.col("_n")) & F.col("next_hash").eqNullSafe(F.col("_nh")))
    return paired.select("doc_id", "n_chars", sha_back.alias("edited_sha256"), "fp", "edited_fp",
                         likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def with_neighbours(rows: DataFrame, queries: Column, radius: int = RADIUS) -> DataFrame:
    """Adds ``near_docs``: for the queried rows, how many rows (itself included) have a fingerprint within the radius; else null."""
    rows = materialize(rows, "rows")
    counts = rows.groupBy("fp").agg(F.count("*").alias("_n"))
    found = within(rows.filter(queries), rows, radius)
    sums = found.join(counts, "fp").groupBy("query_fp").agg(F.sum("_n").alias("_near"))
    return rows.join(sums, rows["fp"] == sums["query_fp"], "left").withColumn("near_docs", F.when(queries, F.col("_near"))).drop("_near", "query_fp")


def readable(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fingerprint": bits_hex(F.col("fp")), "edited_fingerprint": bits_hex(F.col("edited_fp"))}).drop("fp", "edited_fp")
