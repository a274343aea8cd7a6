"""Helpers of the training-data operators: frames of ids and texts, and exact bulk encoding."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
CACHE_ENTRIES = 600_000
HEAVY = 1000  # a key with more than one row in HEAVY is heavy: there are fewer than HEAVY of them
BLANK = r"[\x09-\x0D\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ODD = f"{BLANK}[ \n]|[\\x1c-\\x1f]"  # texts with these are cut with more care
WORDS = re.compile(r"\s*\S+|\s+")
CONTROL = re.compile("[\x1c-\x1f]")

_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text becomes empty. Other columns, whatever their names, stay behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def byte_slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of the column, or a single row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
        yield batch.slice(int(part[0]), len(part))


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on this session hands Python at most so many bytes of rows at a time (or one row): texts are long, and both sides hold what is handed over."""
    spark.conf.set(ARROW_BYTES, str(most))


def give_back() -> None:
    """Free memory of this worker goes back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, with ``give_back`` before and after it."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


class Encoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False)`` of the tokenizers library.

    The vocabularies used here split a text before white space that follows
    something else, whatever stands around it. So pieces are encoded once per
    worker (a cache of at most ``entries``, in two halves), many at a time, and the ids
    of a text are the ids of its pieces in order.
    """

    def __init__(self, path: str, ordinary: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = ordinary
        self.entries = CACHE_ENTRIES
        self.forget()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        width = np.zeros(size, np.int64)
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            width[i] = len(piece)  # one letter of a byte-level piece stands for one byte
        self.width = width

    def forget(self) -> None:
        """Empty the cache: results stay the same."""
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _plain(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if len(self.cache) + len(pieces) > self.entries // 2:
            self.cache, self.old = {"": b""}, self.cache  # what is used again moves over from the old half
        odd = [p for p in pieces if (p[0] not in " \n" and not p[0].isspace()) or p[-1].isspace()]
        self.cache.update(zip(odd, self._plain(odd)))
        odd_set = set(odd)
        rest = [p for p in pieces if p not in odd_set] if odd else pieces
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            found = self.tok.encode_batch_fast(["".join(part[k : k + 32]) for k in range(0, len(part), 32)], add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(e.ids for e in found)), "<u4")
            ends = np.cumsum([len(p.encode()) for p in part])
            done = np.cumsum(self.width[ids])
            cut = np.searchsorted(done, ends) + 1
            if len(done) and (cut[-1] != len(ids) or (done[cut - 1] != ends).any()):
                self.cache.update(zip(part, self._plain(part)))
                continue
            raw, at = ids.tobytes(), (4 * cut).tolist()
            self.cache.update((p, raw[a:b]) for p, a, b in zip(part, [0, *at], at))

    def _table(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, keys))
        if holes := [i for i, x in enumerate(found) if x is None]:
            new: dict[str, None] = {}
            for i in holes:
                k = keys[i]
                if (x := self.old.get(k)) is None:
                    new[k] = None
                else:
                    self.cache[k] = found[i] = x
            self._learn(list(new))
            for i in holes:
                if found[i] is None:
                    found[i] = self.cache[keys[i]]
        return found

    def _careful(self, text: str) -> np.ndarray:
        if CONTROL.search(text):
            return np.frombuffer(self._plain([text])[0], "<u4")
        return np.frombuffer(b"".join(self._table(WORDS.findall(text))), "<u4")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the bounds of each text (one more than there are texts)."""
        column = pc.fill_null(column, "")
        n = len(column)
        if not n:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        odd = np.flatnonzero(pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False))
        careful = {int(i): self._careful(column[int(i)].as_py()) for i in odd}
        if careful:
            column = pc.if_else(pa.array(np.isin(np.arange(n), odd)), "", column)
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        words = lists.flatten().dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        where = words.indices.to_numpy(zero_copy_only=False)
        base = int(lists.offsets[0].as_py())
        first -= base
        starts = [names[w] for w in where[first]]
        # a word at a text's start has no space before it; the space of "\n" is one that was put in
        known = self._table(starts + [w if w[:1] == "\n" else " " + w for w in names])
        where = where + n
        where[first] = np.arange(n)
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.cumsum(size) - size
        count = size[where]
        ends = np.cumsum(count)
        bounds = np.concatenate([[0], ends])[np.append(first, len(where))]
        ids = flat[np.arange(ends[-1]) + np.repeat(at[where] - (ends - count), count)]
        if careful:
            parts = [careful.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(n)]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; it keeps its cache from task to task."""
    key = f"{path}|{ordinary}"
    if key not in _tokenizers:
        _tokenizers[key] = Encoder(path, ordinary)
    return _tokenizers[key]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, for files that Spark has no reader or writer for."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def publish(store: fs.FileSystem, hidden: str, final: str) -> None:
    """Give a finished file its name. A task that ran before has left the same content there, which some stores do not replace."""
    if store.get_file_info(final).type != fs.FileType.NotFound:
        store.delete_file(final)
    store.move(hidden, final)


def folder(path: str) -> str:
    """The path, made where it is missing: the folder of a table without rows has no files."""
    store, root = open_store(path)
    store.create_dir(root, recursive=True)
    return path


def bits_hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows to ``keyed``, whose column ``count`` tells how many of ``total`` rows have its key.

    Fewer than ``HEAVY`` keys have more than one row in ``HEAVY``; these are
    broadcast, so no task gets all rows of a hot key. The others are shuffled.
    """
    heavy, light = F.col(count) * HEAVY > total, F.col(count) * HEAVY <= total
    some = rows.join(F.broadcast(keyed.filter(heavy)), on)
    return some.unionByName(rows.join(F.broadcast(keyed.filter(heavy).select(*on)), on, "left_anti").join(keyed.filter(light), on, how), allowMissingColumns=True)
