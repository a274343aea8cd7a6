"""Large files in blocks: CSV records with line breaks in quotes, and digests of files that no row can hold.

Spark's text reader cuts a file into blocks and gives each task whole lines.
Whether a line begins inside quotes depends on all lines before it, so it is
found in two passes without a shuffle. The first one folds each block into what
it does to either state: where it ends if it begins outside of quotes, and where
if inside. These maps compose, one small row per block, which gives the state
at every block's begin. The second pass cuts the records. Only the pieces of
records that cross a block's end are moved.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.session import materialize

OUTSIDE, INSIDE = 0, 1
_CELLS = rb'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?,)*+'
_OPENS = re.compile(_CELLS + rb'"(?:[^"]++|"")*+\Z')
_REST = re.compile(rb'(?:[^"]++|"")*+')
_AFTER = re.compile(rb'"[^,]*+,?')


def after(line: bytes, state: int) -> int:
    """The state in which a line ends that begins outside or inside of quotes."""
    if state == INSIDE:
        at = _REST.match(line).end()
        if at == len(line):
            return INSIDE
        line = line[_AFTER.match(line, at).end() :]
    return INSIDE if _OPENS.match(line) else OUTSIDE


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, name, block, length, size): lines as bytes, with the file, the block's first byte in it and its length, and the file's size."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Consecutive rows of one file and block."""
    if not batch.num_rows:
        return
    files, blocks = batch.column("file").dictionary_encode(), batch.column("block")
    key = list(zip(files.indices.to_pylist(), blocks.to_pylist()))
    start = 0
    for i in range(1, len(key) + 1):
        if i == len(key) or key[i] != key[start]:
            yield (files.dictionary[key[start][0]].as_py(), key[start][1]), batch.slice(start, i - start)
            start = i


def block_maps(lines: DataFrame) -> DataFrame:
    """(file, block, from_outside, from_inside): the state in which each block ends, for either begin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for key, part in _runs(batch):
                ends = held.setdefault(key, [OUTSIDE, INSIDE])
                quoted = part.column("line").filter(pc.match_substring(part.column("line"), '"'))
                for line in quoted.to_pylist():
                    ends[:] = [after(line, s) for s in ends]
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), *[pa.array([e[s] for e in held.values()], pa.int32()) for s in (0, 1)]],
            ["file", "block", "from_outside", "from_inside"])

    return lines.select("line", "file", "block").mapInArrow(run, "file string, block long, from_outside int, from_inside int")


def starts(maps: DataFrame) -> DataFrame:
    """(file, block, state) at the begin of each block, from the maps of those before it."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("from_outside") > F.col("from_inside")
    turned = maps.withColumn("_swaps", F.coalesce(F.sum(swaps.cast("int")).over(before), F.lit(0)))
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").alias("state"), F.col("_swaps").alias("swaps")))
    last = turned.withColumn("_last", F.last(fixed, ignorenulls=True).over(before))
    state = (F.coalesce(F.col("_last.state"), F.lit(OUTSIDE)) + F.col("_swaps") - F.coalesce(F.col("_last.swaps"), F.lit(0))) % 2
    return last.select("file", "block", state.cast("int").alias("state"))


def csv_blocks(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Records of CSV files of any size, of ``least`` bytes or more: (source_file, record, header, alone, file, block, no).

    ``header`` marks the first record of a file that is not blank, and ``alone``
    the records of files of one block. A line break
    inside quotes belongs to its record; a quote inside a cell that does not
    begin with one is text; quotes that are never closed reach to the end of the
    file. Records of a file are ordered by (block, no). A record is one value of
    a row, so a single one may hold up to 2 GB.
    """
    lines = lines_of(spark, path).filter(F.col("size") >= least)
    inside = materialize(starts(block_maps(lines)).filter(F.col("state") == INSIDE), "inside").collect()  # one row per block that begins in quotes
    known = spark.sparkContext.broadcast({(r.file, r.block) for r in inside})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, alone, state, no, held, head, seen = None, None, True, OUTSIDE, 0, [], False, False
        rows: list[tuple] = []

        def give(kind: str) -> None:
            """kind: whole record, or its begin, middle or end where it crosses blocks."""
            nonlocal no, held, seen
            text = b"\n".join(held)
            first = False
            if kind in ("whole", "begin") and not seen and text.strip(b"\r\n"):
                first = seen = True
            rows.append((key[0], name, key[1], no, kind, first and key[1] == 0, alone, text))
            no, held = no + 1, []

        def close() -> None:
            if key is not None and (held or head):
                give("middle" if head else "begin" if state == INSIDE else "whole")

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            rows.clear()
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "name", "block", "no", "kind", "header", "alone", "text"])

        for batch in batches:
            for now, part in _runs(batch):
                if now != key:
                    close()
                    key, name, no, held, seen = now, part.column("name")[0].as_py(), 0, [], False
                    alone = part.column("length")[0].as_py() >= part.column("size")[0].as_py()
                    state = INSIDE if now in known.value else OUTSIDE
                    head = state == INSIDE  # the record of an earlier block goes on
                column = part.column("line")
                plain = pc.invert(pc.match_substring(column, '"')).to_pylist()
                for line, easy in zip(column.to_pylist(), plain):
                    held.append(line)
                    if not easy:
                        state = after(line, state)
                    if state == OUTSIDE:
                        give("end" if head else "whole")
                        head = False
            yield flush()
        close()
        yield flush()

    found = lines.mapInArrow(run, "file string, name string, block long, no long, kind string, header boolean, alone boolean, text binary")
    found = materialize(found, "records")
    pieces = found.filter("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("block", "no")
    numbered = pieces.withColumn("_id", F.sum((F.col("kind") == "begin").cast("int")).over(order))
    joined = numbered.groupBy("file", "name", "_id").agg(
        F.min(F.struct("block", "no")).alias("at"), F.max("header").alias("header"), F.max("alone").alias("alone"), F.array_sort(F.collect_list(F.struct("block", "no", "text"))).alias("parts"))
    crossing = joined.select("file", "name", F.col("at.block").alias("block"), F.col("at.no").alias("no"), "header", "alone", F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), "\n").alias("record"))
    whole = found.filter("kind = 'whole'").select("file", "name", "block", "no", "header", "alone", F.col("text").cast("string").alias("record"))
    return whole.unionByName(crossing).select(F.col("name").alias("source_file"), "record", "header", "alone", "file", "block", "no")


# ---- digests ----------------------------------------------------------------------------

def large_digests(spark: SparkSession, path: str, least: int) -> DataFrame:
    """(file, filename, size_bytes, sha256, head) of the files of ``least`` bytes or more; head: their first 16 bytes.

    SHA-256 of a file is sequential: its lines are moved to one task in order
    and hashed as a stream, which holds a line at a time. A file may have any
    size, but no line of 2 GB.
    """
    lines = lines_of(spark, path).filter(F.col("size") >= least).withColumn("_id", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, sha, mark, total, n, head, size, name = None, None, None, 0, 0, b"", 0, ""

        def close() -> None:
            # what is missing of the size: 1 for a line end at the end, 3 for a byte order mark, which the reader takes away
            missing = size - total - (n - 1)
            plain, marked = sha, mark
            state = marked if missing >= 3 else plain
            if missing % 3 == 1:
                state.update(b"\n")
            first = (b"\xef\xbb\xbf" + head)[:16] if missing >= 3 else head
            done.append((now, name, size, state.hexdigest(), first))

        for batch in batches:
            for file, label, length, line in zip(*(batch.column(c).to_pylist() for c in ("file", "name", "size", "line"))):
                if file != now:
                    if now is not None:
                        close()
                    now, name, size, total, n, head = file, label, length, 0, 0, b""
                    sha, mark = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
                text = line if n == 0 else b"\n" + line
                sha.update(text)
                mark.update(text)
                if len(head) < 16:
                    head = (head + text)[:16]
                total, n = total + len(line), n + 1
        if now is not None:
            close()
        cols = list(zip(*done)) if done else [()] * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "filename", "size_bytes", "sha256", "head"])

    ordered = lines.repartition("file").sortWithinPartitions("file", "block", "_id")
    return ordered.select("file", "name", "size", "line").mapInArrow(run, "file string, filename string, size_bytes long, sha256 string, head binary")
