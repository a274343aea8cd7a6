import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caselens.llm import packing, planes, tokencount
from caselens.llm.common import Encoder, default_tokenizer, encoder
from caselens.session import materialize, scratch_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(tok):
    r = random.Random(1)
    letters = [*"ab A.,'!1½ \n\t\x1c\x85 é世😀s", "'s", "<|endoftext|>", "  ", "\n\n", " \n", "\n ", "don't", "　", "  "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", " ", "\n", "a ", "a \nb", "a\n b", None]
    ids, bounds = Encoder(default_tokenizer()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(tok, t), repr(t)


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    found = planes.pack_planes(ids, mode)
    assert len(found) == (32 if mode == "bit" else 4)
    assert (planes.unpack_planes(found, n, mode) == ids).all()


def test_crc_of_joined_parts():
    r = random.Random(2)
    for _ in range(200):
        a, b = r.randbytes(r.randint(0, 50)), r.randbytes(r.randint(0, 300))
        assert planes.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("mode,block", [("bit", 100), ("byte", 65536)])
def test_plane_files(spark, edge, tok, mode, block):
    path = scratch_path(spark, "planes")
    planes.write(edge, path, block=block, mode=mode)
    want, at = [], 0
    rows = sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        ids = np.array([*ids_of(tok, r.text), 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in planes.digests(spark, path).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    whole = planes.documents(spark, path).select("start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted((r.start, r.n_tokens, r.c) for r in whole) == [x[1:] for x in want]


def test_plane_files_of_nothing(spark, nothing):
    path = scratch_path(spark, "planes")
    planes.write(nothing, path)
    assert planes.digests(spark, path).count() == 0


def check_packed(pieces, docs, tok, capacity, end_id):
    want = sorted(zlib.crc32(np.array([*ids_of(tok, t), end_id], "<u4").tobytes()) for _, t in docs)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and (p.piece == 0 or p.length == capacity)
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    whole = []
    for ps in by_doc.values():
        for start in [p for p in ps if p.piece == 0]:
            rest = sorted((p for p in ps if p.piece), key=lambda p: p.piece)
            whole.append(zlib.crc32(b"".join([bytes(start.ids), *(bytes(p.ids) for p in rest)])))
    assert sorted(whole) == want
    return by_sequence


@pytest.mark.parametrize("bins", [1, 3, 256])
def test_packing(spark, edge, tok, bins):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    check_packed(packing.pack(edge, open_bins=bins).collect(), docs, tok, 1024, 2)


def test_packing_is_tight(spark, sf, tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sequences = check_packed(packing.pack(docs).collect(), rows, tok, 1024, 2)
    least = -(-sum(len(ids_of(tok, t)) + 1 for _, t in rows) // 1024)
    assert len(sequences) <= 1.03 * least


def test_fullest_bin_closes_first_and_tightest_takes():
    b = packing.Bins(10, 2)
    assert b.add("a", 6) == [] and b.add("b", 5) == []
    assert b.add("c", 4) == [("a", 0, 0), ("c", 0, 6)]  # a's bin is the tighter fit and is full now
    assert b.add("d", 7) == [] and b.add("e", 8) == [("d", 1, 0)]
    assert b.rest() == [("e", 2, 0), ("b", 3, 0)]


def test_packing_nothing(nothing):
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("block", [2, 64, 4 << 20])
def test_token_counts(spark, edge, tok, block):
    path = scratch_path(spark, "flat")
    order = materialize(tokencount.write_flat(edge, path), "order")
    found = tokencount.count_tokens(spark, path, block_bytes=max(block, 2) if block > 2 else 4096).join(order, ["file", "doc_no"])
    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    want = sorted((r.doc_id or -1, len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in edge.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found.collect()) == want


def test_token_counts_of_nothing_and_of_a_second_run(spark, nothing, edge):
    path = scratch_path(spark, "flat")
    assert tokencount.count_tokens(spark, path).count() == 0
    assert tokencount.write_flat(nothing, path).count() == 0 and tokencount.count_tokens(spark, path).count() == 0
    lazy = tokencount.write_flat(edge, path)
    first = materialize(lazy, "order")
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, first.collect()))  # written again over the same names
    assert tokencount.count_tokens(spark, path).count() == edge.count()


def test_separators_across_blocks_and_open_ends(spark, tmp_path):
    ids = np.array([5, 9, 1, 1, 9, 9, 2, 2, 2, 2, 2, 9, 7], "<u2")
    (tmp_path / "x.tokens").write_bytes(ids.tobytes())
    (tmp_path / "y.tokens").write_bytes(b"")
    for block in (2, 4, 6, 1000):
        got = [(r.doc_no, r.start, r.n_tokens, r.ended) for r in tokencount.count_tokens(spark, str(tmp_path), 9, "u2", block).collect()]
        assert sorted(got) == [(0, 0, 2, True), (1, 2, 3, True), (2, 5, 1, True), (3, 6, 6, True), (4, 12, 1, False)]


def test_wide_ids_need_a_wide_type(nothing):
    with pytest.raises(ValueError):
        tokencount.write_flat(nothing, "/tmp/x", end_id=70000)


def test_packing_leaves_no_words_behind(spark, monkeypatch):
    """Workers live on: what a task keeps of its words would be missing to the stages that follow."""
    plain, vocabulary = packing.tidied, default_tokenizer()

    def watched(run):
        def held(batches):
            yield from plain(run)(batches)
            enc = encoder(vocabulary)
            assert len(enc.cache) + len(enc.old) <= 1

        return held

    monkeypatch.setattr(packing, "tidied", watched)
    docs = spark.range(0, 50, 1, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda x: F.md5(x.cast("string")))).alias("text"))
    assert packing.pack(docs).select("doc_id").distinct().count() == 50


def test_encoder_keeps_few_words(tok):
    enc = Encoder(default_tokenizer())
    enc.entries = 200
    texts = [" ".join(f"word{i}x{k}" for i in range(40)) for k in range(50)]
    for t in texts:
        ids, _ = enc.encode(pa.array([t]))
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert len(enc.cache) + len(enc.old) <= 202
    enc.forget()
    assert len(enc.cache) + len(enc.old) == 1
