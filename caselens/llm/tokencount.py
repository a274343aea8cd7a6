"""Token counts of documents in flat token files, found by their end-of-document ids.

The files are bare little-endian ids, one document after another, without any
index. They are read in blocks of bytes by many tasks; each block reports its
separators, and a prefix scan over one row per block joins the documents that
cross a block's end. Paths are those of pyarrow's file systems (file, hdfs, s3,
gs), as flat files have no reader of their own in Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.llm.common import byte_slices, default_tokenizer, encoder, folder, open_store, publish, texts
from caselens.session import materialize

END_ID = 50256
BLOCK_BYTES = 4 << 20
DTYPES = {"u2": 2, "u4": 4}


def write_flat(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, dtype: str = "u2",
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each task's documents as one flat file; lazily returns (file, doc_no, doc_id) in the files' order.

    Texts are encoded as ordinary text, so ``end_id`` stands at documents' ends
    only. A null text is empty: just the end id. A file appears under its name
    when it is whole, so a task that runs twice does no harm. Evaluate once
    (write the returned rows).
    """
    vocabulary = tokenizer or default_tokenizer()
    if end_id >= 1 << 8 * DTYPES[dtype]:
        raise ValueError(f"id {end_id} does not fit {dtype}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, True)
        store, root = open_store(path)
        store.create_dir(root)
        name = f"part-{TaskContext.get().partitionId():07d}.tokens"
        part_name = f"{root}/.{name}.{uuid.uuid4().hex}"
        sink, n = None, 0
        for batch in batches:
            for part in byte_slices(batch):
                ids, bounds = enc.encode(part.column("text"))
                if len(ids) and int(ids.max()) >= 1 << 8 * DTYPES[dtype]:
                    raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
                sink = sink or store.open_output_stream(part_name)
                sink.write(np.insert(ids, bounds[1:], end_id).astype(f"<{dtype}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), pa.array(np.arange(n, n + part.num_rows), pa.int64()), part.column("doc_id")], ["file", "doc_no", "doc_id"])
                n += part.num_rows
        if sink:
            sink.close()
            publish(store, part_name, f"{root}/{name}")

    return texts(docs, id_col, text_col).mapInArrow(write, "file string, doc_no long, doc_id long")


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, dtype: str = "u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, doc_no, start, n_tokens, ended) of every document in the flat files of a folder.

    ``start`` and ``n_tokens`` count ids, the end id included. Ids after a file's
    last separator are a document with ``ended`` false; a file without ids has none.
    """
    width = DTYPES[dtype]
    step = max(width, block_bytes // width * width)
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").schema("path string, modificationTime timestamp, length long, content binary").load(folder(path))
    blocks = files.filter(f"length >= {width}").select(
        name.alias("file"), F.floor(F.col("length") / width).alias("ids"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step).cast("long"))).alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{root}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at(step, r["block"] * step)[: (r["ids"] * width - r["block"] * step)], f"<{dtype}")
                ends = np.flatnonzero(ids == end_id) + r["block"] * (step // width) + 1
                ended = [True] * len(ends)
                total = r["ids"]
                if (r["block"] + 1) * step >= total * width and (not len(ends) or ends[-1] != total):
                    ends, ended = np.append(ends, total), [*ended, False]
                n = max(1, len(ends))  # a block without a separator still has its row
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * n), pa.array([r["block"]] * n, pa.int64()), pa.array(np.arange(n), pa.int64()),
                     pa.array(ends if len(ends) else [None], pa.int64()), pa.array(ended or [None], pa.bool_())], ["file", "block", "k", "ended_at", "ended"])

    found = blocks.repartition(max(1, spark.sparkContext.defaultParallelism), "file", "block").mapInArrow(scan, "file string, block long, k long, ended_at long, ended boolean")
    rows = materialize(found, "separators")
    sums = rows.groupBy("file", "block").agg(F.count("ended_at").alias("_n"), F.max("ended_at").alias("_last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = sums.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.coalesce(F.max("_last").over(before), F.lit(0)).alias("_open"))
    at = Window.partitionBy("file", "block").orderBy("k")
    local = rows.filter("ended_at is not null").withColumn("_prev", F.lag("ended_at").over(at))
    start = F.coalesce("_prev", "_open")
    return local.join(scanned, ["file", "block"]).select(
        "file", (F.col("_base") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("ended_at") - start).alias("n_tokens"), "ended")
