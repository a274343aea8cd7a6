import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import langid, mixing, pii

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / free for s in order}
        over = {s for s in order if s not in full and t[s] > cap * sizes[s] + 1e-9}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 100, 5000]) for s in ["a", "b", "Z", "é", "z1", "", None][: 3 + seed]}
    got = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long"))
    want = brute_targets(sizes)
    for row in got.collect():
        assert row.target == pytest.approx(want[row.source], abs=1e-6)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 500, 400).astype(float)
    p = np.full(400, 0.37)
    out = mixing.fly(sizes, p, rng)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * sizes).sum() == pytest.approx((p * sizes).sum(), abs=1e-3)
    landed = mixing.fly(sizes, p, rng, True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * sizes).sum() - (p * sizes).sum()) < 50


def test_flight_is_fair():
    sizes = np.array([100.0, 7, 3, 3, 9, 1])
    total = sum(mixing.fly(sizes, np.full(6, 0.3), np.random.default_rng(i)) for i in range(4000)) / 4000
    assert np.abs(total - 0.3).max() < 0.04


@pytest.mark.parametrize("sizes", [[], [5], [0, 0, 0], [4, 4, 4, 4], [9, 4, 4, 4]])
def test_small_flights(sizes):
    out = mixing.fly(np.array(sizes, float), np.full(len(sizes), 0.5), np.random.default_rng(1), True)
    assert set(out) <= {0.0, 1.0}


def taken(docs, **how):
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", mixing.words_of(F.col("text")).alias("size"))
    return mixing.mixed(rows, **how).collect()


def test_mix(spark, sf, edge, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, again = taken(docs), taken(docs.repartition(3))
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in again}
    size = {r.doc_id: len(BLANK.findall(r.text)) for r in docs.collect()}
    sums = {}
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 2
        sums.setdefault((r.source, r.target), [0, []])[0] += r.copies * r.size
        sums[(r.source, r.target)][1].append(r.size)
    for (_, target), (n, sizes) in sums.items():
        assert abs(n - target) <= max(0.1 * target, sorted(sizes)[len(sizes) // 2])
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    copies = {r.row: r.copies for r in taken(edge)}
    assert len(copies) == edge.count() and mixed.count() == sum(copies.values())
    assert mixing.mix(nothing).count() == 0


def test_parts_fly_together(spark):
    units = spark.range(3000).select(F.col("id").alias("row"), F.lit(None).cast("string").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("size"), F.lit(0.4).alias("p"), F.lit(3000).alias("n_docs"))
    out = mixing.inclusion(units, part=16).join(units, "row").agg(F.sum("take").alias("n"), F.sum(F.col("take") * F.col("size")).alias("w"), F.count("*").alias("all")).first()
    assert out["all"] == 3000 and abs(out["n"] - 1200) <= 3 and abs(out["w"] - 0.4 * sum(i % 50 + 1 for i in range(3000))) < 60


# --- language

def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.remainder(F.col("doc_id")) == 2
    model = langid.fit(docs.filter(~held))
    got = langid.identify(docs.filter(held), model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_remainder(spark):
    import zlib

    got = spark.range(50).select("id", langid.remainder(F.col("id")).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def brute_viterbi(scores, penalty):
    best, paths = list(scores[0]), [[k] for k in range(len(scores[0]))]
    for s in scores[1:]:
        top = max(range(len(best)), key=lambda k: best[k])
        new, ways = [], []
        for k in range(len(best)):
            stay = best[k] >= best[top] - penalty
            new.append((best[k] if stay else best[top] - penalty) + s[k])
            ways.append((paths[k] if stay else paths[top]) + [k])
        best, paths = new, ways
    return paths[max(range(len(best)), key=lambda k: best[k])]


def test_viterbi_of_many_texts():
    rng = np.random.default_rng(5)
    lengths = [3, 1, 40, 7, 7]
    scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32) * 4
    text = np.repeat(np.arange(5), lengths)
    got = langid.viterbi(scores, text, 3.0)
    for i in range(5):
        assert got[text == i].tolist() == brute_viterbi(scores[text == i].astype(float).tolist(), 3.0)


def test_mixed_scripts_and_spans(spark):
    en, fr, ru = "the house and the garden with the old tree ", "la maison et le jardin avec le vieil arbre ", "дом и сад со старым деревом и рекой "
    docs = spark.createDataFrame([(i, t * 3, lang) for i in range(9) for t, lang in ((en, "en"), (fr, "fr"), (ru, "ru"))], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    langs, scores, spans = model.predict([en * 2 + ru * 3 + fr * 2, "日本語", "12 !", None, ""])
    assert langs[0] == "ru" and [s[2] for s in spans[0]] == ["en", "ru", "fr"]
    assert (en * 2 + ru * 3 + fr * 2)[slice(*spans[0][1][:2])].strip() == (ru * 3).strip()
    assert langs[1] in model.langs and scores[1] == 0 and [s[2] for s in spans[1]] == ["und"]
    assert langs[2:] == ["und"] * 3 and scores[2:] == [0.0] * 3


def test_language_edges(edge, nothing):
    model = langid.fit(edge)
    assert model.langs == ["en", "fr"]
    got = langid.identify(edge, model, ["doc_id", "source", "start"]).collect()
    assert len(got) == edge.count() and {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 9)} == {"und"}
    none = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(edge, none, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(nothing, model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        langid.identify(edge, model, ["score"])


# --- personal data

def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans():
    r = random.Random(3)
    parts = ["a", "b", ".", "@", "-", "_", "+", "1", "2", "9", "255", "0", "00300", " ", "(", ")", "é", "\n", "4111111111111111", "a@b.c", "+1 (212) 555-0100", "٣"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 20)))
        assert pii.base_spans(t) == brute_base(t), repr(t)


def test_likelihood_against_all_segmentations():
    field = pii.Field({"phone": 0.3, "card": -0.2, "phone:usual=True": 1.0})
    line = pii.Line("call 212-555-0100 now 4111 1111 1111 1111")
    segs = pii.segments(line)

    def ways(at):
        if at == len(line.tokens):
            yield ()
            return
        yield from ways(at + 1)
        for s in segs:
            if s[0] == at:
                for rest in ways(s[1]):
                    yield (s, *rest)

    every = list(ways(0))
    score = lambda way: sum(field.score(s[3]) for s in way)
    assert len(every) > 3
    z = np.log(sum(np.exp(score(w)) for w in every))
    gold = {s[:3] for s in max(every, key=score)}
    like, _ = field.gradient(len(line.tokens), segs, gold)
    assert like == pytest.approx(max(map(score, every)) - z)
    found = field.decode(line)
    assert sum(field.score(next(s[3] for s in segs if s[:3] == g)) for g in found) == pytest.approx(max(map(score, every)))


def test_field_on_lines_not_seen():
    field = pii.trained()
    hit = wrong = missed = 0
    for text, spans in pii.examples(500, 77):
        line = pii.Line(text)
        got = {(line.tokens[i][0], line.tokens[j - 1][1], k) for i, j, k in field.decode(line)}
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.93


def test_added_spans():
    find = lambda t: pii.joined(pii.find(t, pii.trained())[1])
    t = "x +1 (269) 555-3296 4524132264652876 and"  # runs into one another: the patterns drop both
    assert pii.base_spans(t) == [] and find(t) == "phone:2:19,card:20:36"
    assert find("write to jane.doe [at] mail [dot] org soon") == "email:9:37"
    for clean in ("Licensed under version 2.0. See 1.5.3.", 'token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "on 2024-01-05 at noon. The 12 dogs", "we met at home. Dot was there", "1234567890123456"):
        assert find(clean) == "", clean


def test_masking(edge, nothing):
    assert pii.masked("a b@c.de x +1 (212) 555-0100", [(2, 8, "email"), (11, 28, "phone"), (12, 15, "ip")]) == "a [EMAIL] x [PHONE]"
    out = pii.mask(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert {r.text for r in out.collect()} == {r.text for r in edge.collect()}
    found = pii.personal_data(edge, ["doc_id", "start"]).collect()
    assert len(found) == edge.count() and all(r.pii_spans == [] for r in found)
    assert pii.personal_data(nothing, ["doc_id"]).count() == 0 and pii.mask(nothing).count() == 0


@pytest.mark.parametrize("text,want", [("please write to jane.doe [AT] example [DOT] org about it", "jane.doe [AT] example [DOT] org"), ("please mail jane AT example DOT org about it", "jane AT example DOT org"),
                                       ("please mail Jane At Example Dot Com about it", "Jane At Example Dot Com"), ("please mail jane at my-host dot org about it", "jane at my-host dot org"),
                                       ("the server at fe::abcd:beef answers", "fe::abcd:beef"), ("ping FEED:BEEF:CAFE:ABCD:FACE:DEAD:BABE:FADE now", "FEED:BEEF:CAFE:ABCD:FACE:DEAD:BABE:FADE")])
def test_any_case_without_digits(text, want):
    assert want in text[slice(*pii.stretches(text)[0])]
    assert [text[s:e] for s, e, _ in pii.find(text, pii.trained())[1]] == [want]


def test_runs_of_letters_end_with_their_script():
    w = langid.Words(["iPhoneの新しい画面", "漢字", "abc где", "aʼb"])
    names = [langid.NAMES[i] for i in w.script]
    assert list(zip(w.size.tolist(), names))[:2] == [(6, "latin"), (6, "kana")]
    assert names[2] == "han" and names[3:5] == ["latin", "cyrillic"] and w.text.tolist()[:5] == [0, 0, 1, 2, 2]


def test_more_labels_than_a_byte_holds():
    r = np.random.default_rng(1)
    scores = np.full((40, 300), -5.0, np.float32)
    want = np.repeat(r.integers(128, 300, 8), 5)
    scores[np.arange(40), want] = 0
    assert langid.viterbi(scores, np.zeros(40, np.int64), 1.0).tolist() == want.tolist()


@pytest.mark.parametrize("text,want", [
    ("write anna.maria.von.der.leyen [at] x [dot] eu now", "anna.maria.von.der.leyen [at] x [dot] eu"), ("mail john.smith [at] mail [dot] example [dot] co [dot] uk please", "john.smith [at] mail [dot] example [dot] co [dot] uk"),
    ("host 2001:db8::ff00:42:8329 up", "2001:db8::ff00:42:8329"), ("reach jane.doe [AT] example [DOT] org", "jane.doe [AT] example [DOT] org"), ("meet me at noon dot com today", None), ("look at the dot there", None),
    ("x" * 300 + ".y [at] host [dot] net end", "x" * 300 + ".y [at] host [dot] net")])
def test_whole_addresses(text, want):
    assert [text[s:e] for s, e, _ in pii.find(text, pii.trained())[1]] == ([want] if want else [])


def planted(seed, n=300):
    """Personal data of other makers than those that the field learns from."""
    r = random.Random(seed)
    names, hosts = ["lena.fischer", "p_dupont", "o.garcia.lopez", "miller77"], ["beispiel", "exemple-mail", "ejemplo", "corp.example"]
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    for _ in range(n):
        kind = r.choice(["email", "phone", "ip", "card"])
        if kind == "email":
            at, dot = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("@", "."), (" at ", " dot ")])
            value = f"{r.choice(names)}{at}{r.choice(hosts).replace('.', dot)}{dot}{r.choice(['com', 'org', 'de'])}"
        elif kind == "phone":
            value = r.choice([f"+{r.randint(30, 49)} {d(3)} {d(7)}", f"({r.randint(201, 989)}) {d(3)}-{d(4)}", f"00{r.randint(30, 49)} {d(3)} {d(7)}"])
        elif kind == "ip":
            value = r.choice([".".join(str(r.randint(40, 255)) for _ in range(4)), f"2001:db8:{r.randint(16, 65535):x}::{r.randint(16, 65535):x}:{r.randint(16, 65535):x}"])
        else:
            digits = "4" + d(14)
            digits += next(c for c in "0123456789" if pii.luhn(digits + c))
            value = r.choice(["", " ", "-"]).join(digits[i : i + 4] for i in range(0, 16, 4))
        yield kind, f"please note {value} for later", 12, 12 + len(value)


def test_recall_by_kind():
    hit, of = {}, {}
    for kind, text, s, e in planted(11):
        spans = pii.find(text, pii.trained())[1]
        of[kind] = of.get(kind, 0) + 1
        hit[kind] = hit.get(kind, 0) + any(a <= s and b >= e for a, b, _ in spans)
    assert all(hit[k] >= 0.9 * of[k] for k in of), (hit, of)
