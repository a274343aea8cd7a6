"""Near-duplicates by SimHash fingerprints and by Jaccard likeness of shingle sets.

Two texts are linked if the fingerprints of their sets differ in few bits, which
the Gray-order index finds, or if their sets have the likeness asked for, which
the heavy-light join finds and verifies on whole sets. Neither holds the other:
no radius on 64-bit fingerprints finds every pair of likeness 0.8, and texts of
close fingerprints may fall short of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import neardup, setjoin
from caselens.session import materialize


def proposed(rows: DataFrame, radius: int = neardup.RADIUS) -> DataFrame:
    """(u, v): set names that the Gray-order index ties together, from rows of ``setjoin.named_sets``."""
    sims = materialize(rows.filter("__n > 0").groupBy(F.col("__sim").alias("fp"), F.col("__fp").alias("name")).agg(F.count("*").alias("_c")).drop("_c"), "sims")
    least = materialize(sims.groupBy("fp").agg(F.min("name").alias("least")), "least")
    near = neardup.edges(least.select("fp"), radius)
    for c in "uv":
        near = near.join(least.select(F.col("fp").alias(c), F.col("least").alias(f"l{c}")), c)
    same = sims.join(least, "fp").filter("name <> least").select(F.col("name").alias("u"), F.col("least").alias("v"))
    return same.unionByName(near.select(F.col("lu").alias("u"), F.col("lv").alias("v")))


def keep_one(docs: DataFrame, words: int = setjoin.WORDS, least: tuple[int, int] = setjoin.LEAST, radius: int = neardup.RADIUS, few: int = setjoin.FEW, block: int = setjoin.BLOCK,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component of texts within ``radius`` bits or at likeness ``least`` or more the one with the smallest id.

    Texts without words are alike with nothing and all stay. Equal rows are
    copies of each other. A row without id stays only if its component has no
    id. An empty table stays empty.
    """
    rows = setjoin.named_sets(docs, docs.columns, text_col, words)
    texts = rows.select(rows[text_col].cast("string").alias("__text"))
    near = materialize(proposed(rows, radius), "near")
    sets = setjoin.components(rows, texts, words, least, few, block, near)
    tied = neardup.stars(sets.select(F.col("fp").alias("u"), F.col("root").alias("v")).unionByName(near))
    roots = tied.select(F.col("u").alias("fp"), "root").unionByName(tied.select(F.col("root").alias("fp"), "root").distinct())
    each = rows.filter("__n > 0").select("__fp", "__row", F.struct(rows[id_col].isNull().alias("no"), rows[id_col].cast("long").alias("id"), F.col("__row").alias("row")).alias("s"))
    small = materialize(each.groupBy("__fp").agg(F.min("s").alias("s")), "small")
    placed = small.join(roots, small["__fp"] == roots["fp"], "left").withColumn("__group", F.coalesce("root", "__fp"))
    first = placed.groupBy("__group").agg(F.min("s")["row"].alias("__stays"))
    # the rows that go are fewer than those that stay: with their number known, they may be small enough to be sent to the texts
    stay = materialize(first.select(F.col("__stays").alias("__row")), "stay")
    gone = materialize(rows.filter("__n > 0").select("__row").join(stay, "__row", "left_anti"), "gone")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
